"""operators of the knowledge-graph engine."""
