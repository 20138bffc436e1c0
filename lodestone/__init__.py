"""Lodestone: data mining and graph analytics on Spark DataFrames."""
