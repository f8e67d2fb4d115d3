"""Documents with every awkward case, for the tests of this folder."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINES = "one two three\nfour five six\nseven eight nine\nten eleven twelve"
ROWS = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, " \t\n ", "en", "a", 4),
    (4, LINES, "en", "a", 40),
    (5, LINES, "en", "b", 40),
    (5, LINES, "en", "b", 40),
    (6, LINES.upper(), "en", "b", 40),
    (7, LINES + "\nthirteen fourteen", "fr", "b", 60),
    (8, "word", "fr", "b", 4),
    (9, "Grüße, Ünïcode 日本語 😀 it's <|endoftext|> 'll 123 x", "de", None, 30),
    (10, "a b " * 30_000 + "x" * 20_000, "en", "a", 140_000),
    (None, LINES, "en", "a", 40),
]
