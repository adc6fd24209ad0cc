"""Log-trend analytics and time-aware retrieval on Spark DataFrames."""
