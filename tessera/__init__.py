"""Batch map/reduce, text and graph analytics as declarative Spark plans."""
