"""Price mining and analysis of large text collections on Spark DataFrames."""
