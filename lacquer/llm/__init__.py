"""Operators for text that is to become training data. Nothing else in the library imports this."""
