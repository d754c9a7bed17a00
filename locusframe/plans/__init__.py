"""Whole analyses, each a function from calls to a result table."""
