"""Readers, ingest steps and the result sink."""
