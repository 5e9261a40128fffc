"""lexigrid: document, vector and cluster analytics on Spark DataFrames."""
