"""Spark-native analytics over threat-intelligence knowledge graphs."""

__all__ = ["session", "tables", "lineage"]
