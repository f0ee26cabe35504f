"""Price-history analytics on PySpark: every operator is a function from DataFrames (and an explicit time) to a DataFrame."""
