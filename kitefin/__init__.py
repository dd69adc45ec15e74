"""Program-graph analytics on Spark DataFrames."""
