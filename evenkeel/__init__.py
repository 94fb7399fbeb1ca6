"""evenkeel: skew-resilient distributed joins, built from Spark DataFrames."""
