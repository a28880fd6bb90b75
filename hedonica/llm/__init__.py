"""Operators that prepare training data from text, one module each."""
