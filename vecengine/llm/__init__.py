"""Operators for preparing training text at scale.

Nothing outside this package imports it.  Every operator takes and returns DataFrames; the thin
queries that bind them to the tables live in :mod:`vecengine.llm.entry`.
"""
