"""DataFrame operators of graph construction and retrieval."""
