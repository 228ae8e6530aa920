"""Column-relationship validation on Spark DataFrames."""
