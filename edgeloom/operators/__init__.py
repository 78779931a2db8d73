"""Operators from DataFrames to DataFrames.

What they do with odd rows, unless a function says otherwise: an empty table gives an empty result (a grid of buckets its zeros, a
global sum one row).  A null id is nobody: it has no vector, mapping or neighbours, and joins leave it out; counts by node keep
it as a group of its own; edges with a null end are in no bucket, but keep their place in numberings, batches and splits.
Repeated edges count each time.  Other columns are carried along where rows are passed on, and not read otherwise.
"""
