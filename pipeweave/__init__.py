"""pipeweave: spatial utility-network analytics on Spark DataFrames."""
