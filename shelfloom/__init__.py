"""shelfloom: catalog analytics on Spark DataFrames."""
