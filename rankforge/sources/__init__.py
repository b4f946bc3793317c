"""Readers: log lines, ratings, items, and the results the sinks wrote."""

from rankforge.sources.inputs import read_items, read_lines, read_ratings
from rankforge.sources.results import read_counts, read_recommendations

__all__ = ["read_counts", "read_items", "read_lines", "read_ratings", "read_recommendations"]
