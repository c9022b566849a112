"""Joins, aggregations and labelling over keyword and log tables."""
