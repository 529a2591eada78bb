"""Readers of documents, extraction results and texts; writers of graphs, caches and tables."""
