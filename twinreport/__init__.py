"""Report similarity analytics on Spark DataFrames."""
