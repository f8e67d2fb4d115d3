"""Relational operators of the archive: merges, quality checks, timelines and exports."""
