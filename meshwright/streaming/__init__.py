"""streaming of the knowledge-graph engine."""
