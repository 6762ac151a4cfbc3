"""Operators for large-scale text pipelines; nothing else in the library imports this subpackage."""
