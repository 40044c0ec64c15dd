"""Operators of a training-data pipeline.

Each module holds one operator with a general interface; `queries` binds the
operators to the driver tables.  Nothing outside this subpackage imports it.
"""
