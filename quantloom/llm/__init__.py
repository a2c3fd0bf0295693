"""Operators for preparing training data out of large text corpora."""
