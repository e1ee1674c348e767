"""headerloom: message-archive analytics written for Spark (DataFrames, SQL, Structured Streaming)."""
