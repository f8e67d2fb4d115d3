"""Whole pipelines of the archive, and the catalogue of registered queries."""
