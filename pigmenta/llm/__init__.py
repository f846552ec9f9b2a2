"""Operators on text for preparing training data. Nothing outside this package imports it."""
