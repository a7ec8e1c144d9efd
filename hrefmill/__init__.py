"""Cleaning, searching and auditing very large link collections with Spark DataFrames."""
