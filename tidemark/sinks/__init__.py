"""Places results are written to."""
