"""Operators of a training-data pipeline: quality, archives, near copies, search, packing, tokens."""
