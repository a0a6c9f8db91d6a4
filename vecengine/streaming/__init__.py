"""Searches over streams of queries."""
