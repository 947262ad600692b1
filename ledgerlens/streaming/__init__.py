"""Streaming of the risk-analytics engine."""
