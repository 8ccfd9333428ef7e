"""Operators over DataFrames: itemsets, graphs, clusters, diffusion, vectors, graph layers, metrics."""
