"""Transaction-network risk analytics on Spark DataFrames."""
