"""freshet: rainfall-runoff early warning analytics on Spark DataFrames."""
