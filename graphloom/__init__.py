"""graphloom: code-knowledge analytics on Spark DataFrames."""
