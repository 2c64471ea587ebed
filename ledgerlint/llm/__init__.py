"""Operators of a training-data pipeline: encoding, deduplication, filtering, mixing, archives."""
