"""Incremental arrival of survey lines."""
