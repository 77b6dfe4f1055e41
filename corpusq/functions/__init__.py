"""Subpackage of corpusq."""
