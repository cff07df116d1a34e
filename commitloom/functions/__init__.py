"""Column functions: parsing, path rules, diff features."""
