"""functions of the knowledge-graph engine."""
