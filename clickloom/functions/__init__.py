"""Scalar and table functions as Columns: URLs, time buckets, serving keys."""
