"""Operators for building training data from a corpus; nothing outside this package imports it."""
