"""Tidemark: hot, event-shaped time-series tables on Spark DataFrames."""
