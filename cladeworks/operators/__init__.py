"""Operators over DataFrames: taxonomy, pairs, triplets, sampling, graphs, vectors, metrics, control."""
