"""Training-data operators: thirteen dataset-scale jobs over documents, pages, conversations and vectors.

Nothing outside this subpackage imports it.  ``queries.py`` binds each operator
to its table, ``oracles.py`` holds the DuckDB statements that check them.
"""
