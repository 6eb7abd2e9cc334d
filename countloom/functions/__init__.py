"""Column functions: scalars and discrete distributions."""
