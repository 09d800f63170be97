"""Relational building blocks: orders, neighbours, balls, conflicts, greedy rounds."""
