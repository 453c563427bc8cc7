"""Operators for preparing training data at scale.

Nothing else in ``corpusgraph`` imports this subpackage.  Each operator module
exposes a general DataFrame -> DataFrame function; ``queries`` holds the thin
registered queries with their production parameters.
"""
