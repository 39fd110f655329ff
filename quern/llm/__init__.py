"""Operators of a training-data pipeline: language, duplicates, leaks, mixing, scores, token files, shards."""
