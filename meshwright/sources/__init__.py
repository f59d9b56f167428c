"""sources of the knowledge-graph engine."""
