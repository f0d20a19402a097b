"""Column functions: text normalisation, value parsing and validation."""
