"""Scalar functions with the semantics of the query dialect."""
