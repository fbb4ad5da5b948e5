"""Operators of a training-data pipeline: duplicates, quality, mixing, tokens, search.

Nothing else in the library imports this package. Each module holds one operator with
its general interface; ``queries`` registers the thin ``opN_`` queries over them.
"""
