"""Activity-risk scoring and training-data trust on Spark DataFrames."""
