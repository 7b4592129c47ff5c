"""Composed steps, their command line, and the registry of queries."""
