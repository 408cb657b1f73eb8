"""Relational, graph, retrieval and quality operators."""
