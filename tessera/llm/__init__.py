"""Operators of a training-data pipeline.

Nothing outside this subpackage imports it. Every operator names its input
columns as parameters, takes only those columns from its input (so extra
columns, whatever their names, never clash with internal ones) and states in
its docstring what nulls, empty and very long texts, ties and repeated rows
give.
"""
