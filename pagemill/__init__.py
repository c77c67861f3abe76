"""pagemill: corpus-scale document audit and training-data preparation on Spark DataFrames."""
