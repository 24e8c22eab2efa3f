"""Sequence and sequence-graph alignment on Spark DataFrames."""

from seqloom.session import build_session, materialise

__all__ = ["build_session", "materialise"]
