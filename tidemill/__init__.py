"""Leased message queues as Spark DataFrames."""
