"""Server-log analytics on Spark: parse, order, deduplicate, explain."""
