"""Document-integrity analytics on Spark DataFrames."""
