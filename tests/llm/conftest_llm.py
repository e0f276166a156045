"""Rows that every operator must stand: nulls, empty and blank texts, repeats, a very long text."""

ODD = [(None, "a b c"), (1, None), (2, ""), (3, " \t\n"), (4, "one two three four five six"), (4, "one two three four five six"), (5, "one two three four five six"), (6, "word " * 60_000)]
