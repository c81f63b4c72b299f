"""Tessella: a Spark-first engine for building, cleaning and querying text corpora.

Every operator is a function from DataFrames to a DataFrame.  Work is declared
with built-in functions wherever they can state the rule; Python is entered in
Arrow batches, never row by row.
"""

__version__ = "0.1.0"
