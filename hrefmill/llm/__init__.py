"""Operators for training-data pipelines: cleaning, near-duplicates, privacy, tokens, language and shards."""
