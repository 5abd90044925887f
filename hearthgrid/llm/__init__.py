"""Corpus operators for training data: counting, fingerprints, sharding, classifiers, scans, dedup and packing."""
