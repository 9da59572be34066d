"""Operators for training data at scale: texts, tokens, vectors."""
