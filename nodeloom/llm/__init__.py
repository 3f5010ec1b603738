"""Operators of a training-data pipeline: near-duplicate joins, tokenizing, search, filters and mixing.

Self-contained: nothing else in ``nodeloom`` imports this subpackage.
"""
