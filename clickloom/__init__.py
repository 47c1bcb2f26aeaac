"""Clickloom: web analytics on Spark DataFrames (batch views, serving exports and streaming views)."""
