"""A document extraction engine on Spark DataFrames."""
