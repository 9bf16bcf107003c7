"""millrace: retrieval-evaluation analytics on Spark DataFrames."""
