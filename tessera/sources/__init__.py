"""Reading and writing objects and key/value data."""
