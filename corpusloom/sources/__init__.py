"""Readers and the helpers that cut lineage."""
