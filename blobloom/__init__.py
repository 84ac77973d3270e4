"""Archive and lossless-codec analytics on Spark DataFrames."""
