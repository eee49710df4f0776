"""corvane: record-store analytics on Spark DataFrames."""
