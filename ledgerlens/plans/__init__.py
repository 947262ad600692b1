"""Plans of the risk-analytics engine."""
