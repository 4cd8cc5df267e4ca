"""Operators for training corpora: text, vectors, pages and conversations."""
