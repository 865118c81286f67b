"""Relational operators: ranking, fusion, page cleaning, integrity checks."""
