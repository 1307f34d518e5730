"""Checks and measures over DataFrames, one module per subject."""
