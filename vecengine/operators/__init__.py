"""Operators over tables of vectors: search, clustering, quantisation, graphs, evaluation."""
