"""Functions of the risk-analytics engine."""
