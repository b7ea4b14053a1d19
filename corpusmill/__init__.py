"""corpusmill: text-corpus analytics on Spark DataFrames."""
