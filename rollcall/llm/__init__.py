"""Operators for training-data pipelines: cleaning, packing, tokenising, extraction, fingerprints, filters, archives, shards, near-duplicates."""
