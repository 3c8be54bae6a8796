"""Contract and policy text analytics on Spark DataFrames."""
