"""Operators of a training-data pipeline: sharding, tokens, near and exact duplicates, formatting, scans and extraction."""
