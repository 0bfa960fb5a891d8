"""Group nearest-neighbour analytics on Spark DataFrames."""
