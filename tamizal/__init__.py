"""tamizal: document-evidence analytics on DataFrames, Spark SQL and Structured Streaming."""
