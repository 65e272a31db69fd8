"""starmesh: point-set analytics and training-data preparation on Spark DataFrames."""
