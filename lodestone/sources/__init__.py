"""Readers and writers of the file formats that the operators take."""
from .files import (baskets_text, books_csv, documents_text, edges_csv, edges_text, graph_adjacency, graph_parts, numbered_lines, round_report, stories_csv)

__all__ = ["baskets_text", "books_csv", "documents_text", "edges_csv", "edges_text", "graph_adjacency", "graph_parts", "numbered_lines", "round_report", "stories_csv"]
