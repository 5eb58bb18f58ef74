"""Blocked-sparse graph analytics and graph-learning data preparation on Spark DataFrames."""
