"""Operators for large text corpora: packing, filtering, deduplication, mixing,
search, counting and output of training data."""
