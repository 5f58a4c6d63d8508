"""Analytics over text, vector and experiment-run tables, built on Spark DataFrames."""
