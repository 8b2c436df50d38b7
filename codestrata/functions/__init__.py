"""Scalar functions for SQL; as columns they stand beside the operators that use them."""
