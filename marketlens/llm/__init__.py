"""Operators of a training-data pipeline: mixing, deduplication, quality, sharding, tokens, toxicity."""
