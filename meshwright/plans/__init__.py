"""plans of the knowledge-graph engine."""
