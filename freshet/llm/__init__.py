"""Corpus preparation for language-model training; nothing else in the library imports this package."""
