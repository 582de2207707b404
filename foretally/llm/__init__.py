"""Corpus operators for preparing training data, and the queries built on them."""
