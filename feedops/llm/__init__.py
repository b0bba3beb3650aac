"""Operators for preparing text corpora: one module per operator, queries beside them, nothing else in the package imports them."""
