"""A consensus-analytics engine on Spark DataFrames."""
