"""Operators that large text and vector corpora need before training; nothing else in the library imports this package."""
