"""Operators of a training-data pipeline over documents, pages and conversations.

Each module holds one operator with its own general interface; ``queries``
registers the thin digests of their results. Nothing else in the library
imports this subpackage.
"""
