"""Text retrieval, ranking features and training-data preparation on Spark DataFrames."""
