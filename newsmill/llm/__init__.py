"""Corpus-preparation operators for training data (nothing outside imports this)."""
