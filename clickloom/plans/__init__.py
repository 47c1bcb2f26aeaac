"""Batch views composed of operators."""
