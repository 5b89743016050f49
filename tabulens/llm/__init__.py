"""Operators for text corpora on the way to training data, and the queries that apply them."""
