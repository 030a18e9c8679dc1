"""Column functions: text in, column expression out."""
