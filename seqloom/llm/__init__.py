"""Operators for corpora used in language-model training. Nothing else in seqloom imports this."""
