"""Relational forms of the graph, scan, histogram and timing operators."""
