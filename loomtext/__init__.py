"""Long-context analytics on Spark: chunk, ask, reduce, and roll up run logs."""
