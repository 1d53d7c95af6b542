"""Feeds, the source registry and fetch results as DataFrames."""
