"""Column functions: match kernels and text functions."""
