"""Readers and writers of binary vector files and answers."""
