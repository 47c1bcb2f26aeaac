"""The speed layer: incremental views of a stream of page views."""
