"""blockloom: content-addressed block-cache analytics on Spark DataFrames."""
