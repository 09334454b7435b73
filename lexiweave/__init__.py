"""lexiweave: a Spark-native engine for multilingual lexical data.

Every operator is a function from DataFrames to a DataFrame; nothing is
collected unless its size has a stated bound.
"""

__version__ = "0.1.0"
