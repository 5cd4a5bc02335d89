"""Vessel encounter analytics on Spark DataFrames."""
