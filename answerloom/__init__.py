"""Spark-native curation, checking, scoring and monitoring of chat samples and model answers."""

from answerloom.session import cut_lineage, get_session

__all__ = ["cut_lineage", "get_session"]
