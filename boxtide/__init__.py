"""Detection-label analytics on Spark DataFrames."""
