"""Column expressions: encoding, profiles, distances, edits."""
