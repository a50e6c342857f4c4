"""Operators for training-data preparation: cleaning, deduplication, scoring, formatting and tokens."""
