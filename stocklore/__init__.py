"""A material and item data engine on Spark DataFrames."""
