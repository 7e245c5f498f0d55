"""Document analysis and corpus processing on Spark DataFrames."""
