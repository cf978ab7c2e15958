"""Column functions: paths and names, redaction, rounding and dates."""
