"""A document-query engine on Spark DataFrames."""
