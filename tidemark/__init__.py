"""Cross-sectional relative-strength analytics on Spark DataFrames."""
