"""Operators of a training-data pipeline over text corpora.

Nothing else in the library imports this subpackage.  Every operator takes
DataFrames and column names, selects the columns it needs (so extra columns of
any name are harmless) and returns a DataFrame.
"""
