"""Column macros, expression compilers and special functions."""
