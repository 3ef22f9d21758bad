"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator is a function from DataFrames to a
DataFrame with its own general interface; ``queries.py`` holds the registered ``opN_*`` queries,
which derive their digest columns from the operators' outputs.
"""
