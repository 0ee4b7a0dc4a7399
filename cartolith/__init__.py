"""Repository analytics on Spark: files, references, graphs and context texts as DataFrames."""
