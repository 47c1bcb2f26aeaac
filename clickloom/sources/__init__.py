"""Stored data: the fact store, the serving tables and stream sources."""
