"""Operators of the risk-analytics engine."""
