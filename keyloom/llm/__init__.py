"""Operators for building training data: mixing, scanning, labelling, deduplicating, scoring, packing, searching.

Nothing outside this package imports it. `queries` holds the registered queries and their SQL.
"""
