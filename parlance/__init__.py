"""Message-text analytics on Spark DataFrames."""
