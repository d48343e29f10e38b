"""Operators for preparing training data at corpus scale.

Nothing else in the library imports this subpackage.  Every operator takes
DataFrames and returns DataFrames; ``queries.py`` holds the thin ``opN_<name>``
queries that bind them to the driver's tables.
"""
