"""Operators for building and cleaning training corpora."""
