"""Operators of a training-data pipeline over web-scale text.

One module for each operator; ``queries`` binds them to the driver tables.
Nothing outside this package imports it.
"""
