"""Sources of the risk-analytics engine."""
