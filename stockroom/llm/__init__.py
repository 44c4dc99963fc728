"""Operators for large text corpora: one module per operator, registered in `queries`."""
