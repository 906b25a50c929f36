"""Operators of a training-data pipeline: language ID, deduplication, tokenizing, extraction, scans.

Nothing else in the library imports this subpackage. Each operator has a general interface in its
module; ``queries.py`` holds the thin queries ``opN_<name>`` over the standard tables.
"""
