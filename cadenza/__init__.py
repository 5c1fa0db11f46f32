"""cadenza: symbolic-music analytics on Spark DataFrames, SQL and Structured Streaming."""
