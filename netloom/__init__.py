"""netloom: embedded-network matching analytics on Spark DataFrames."""
