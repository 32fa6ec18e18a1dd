"""Operators of a training-data pipeline: scan, score, deduplicate, encode, search and place documents."""
