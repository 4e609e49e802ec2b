"""Corpus-preparation operators for large training-data sets.

Nothing else in the library imports this subpackage.  Each module holds one
operator; ``queries`` holds the thin contract queries and their SQL.
"""
