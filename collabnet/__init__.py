"""Collaboration-network analytics on Spark DataFrames."""
