"""millrace: multilingual text retrieval, its evaluation and its analytics on Spark DataFrames."""
