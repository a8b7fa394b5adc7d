"""Column types, key encodings and text functions."""
