"""Event-sequence relational analytics on Spark DataFrames."""
