"""Find, mask and report on sensitive data with Spark DataFrames."""
