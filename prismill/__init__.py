"""Business analytics and tabular machine learning on Spark DataFrames."""
