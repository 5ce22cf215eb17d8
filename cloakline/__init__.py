"""Document de-identification and text processing on Spark DataFrames."""
