"""Contact-graph analytics on Spark DataFrames."""
