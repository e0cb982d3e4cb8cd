"""Training-data operators: ten corpus operators on Spark DataFrames.

Nothing outside this subpackage imports it, so it can be removed without
touching the record-linkage library.
"""
