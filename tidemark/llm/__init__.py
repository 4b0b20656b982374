"""Operators of a training-data pipeline: scoring, search, packing, cleaning, files."""
