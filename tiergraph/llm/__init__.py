"""Operators for building training corpora.

Nothing else in the package imports this one.  Every operator takes a DataFrame
and the names of the columns it reads, so that extra columns, whatever their
names, are never touched.
"""
