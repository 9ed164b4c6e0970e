"""Grouped aggregation, graph preparation, ranking, paths and partitioning."""
