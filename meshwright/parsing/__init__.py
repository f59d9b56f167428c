"""parsing of the knowledge-graph engine."""
