"""Column functions: transforms, expressions, strings, image arrays."""
