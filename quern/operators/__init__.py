"""Operators: DataFrame in, DataFrame out, no action inside unless the docstring says so."""
