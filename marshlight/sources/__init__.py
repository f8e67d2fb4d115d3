"""Readers: JSON archives, capture tables, cached pages, and extraction from HTML and KML."""
