"""Session-log analytics and deduplication on Spark DataFrames."""
