"""Solvers that run inside a chunk, on arrays; Spark deals the chunks out."""
