"""Operators that prepare training text: deduplication, quality, privacy, archives, secrets, tokens, mixing, search, licences.

Nothing else in the library imports this subpackage. Each operator takes DataFrames and column names, selects the columns
that it needs (so extra columns never clash) and returns a DataFrame.
"""
