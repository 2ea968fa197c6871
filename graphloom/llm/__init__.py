"""Training-data operators: every operator takes and returns Spark DataFrames.

Nothing else in the library imports this subpackage.
"""
