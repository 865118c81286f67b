"""Whole query plans composed from operators, with their SQL oracles."""
