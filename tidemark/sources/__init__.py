"""Places data is read from."""
