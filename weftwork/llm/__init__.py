"""Operators that prepare text corpora for training: duplicates, filters, extraction, encodings."""
