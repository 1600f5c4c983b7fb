"""Reading datasets and keeping run records as tables."""
