"""Operators that prepare training data from repositories. Nothing outside imports this package."""
