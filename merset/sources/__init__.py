"""Where k-mers come from: the full space, or the text of a table."""
