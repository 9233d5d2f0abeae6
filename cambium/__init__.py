"""Cambium: sequencing-depth and saturation analytics on Spark DataFrames."""
