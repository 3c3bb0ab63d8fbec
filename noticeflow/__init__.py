"""Notice and news analytics on Spark DataFrames."""
