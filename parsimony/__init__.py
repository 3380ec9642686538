"""Token-aware payload analytics and corpus preparation on Spark DataFrames."""
