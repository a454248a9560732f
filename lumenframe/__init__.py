"""Batch raster processing on Spark DataFrames."""
