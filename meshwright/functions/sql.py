"""The scalar functions for SQL texts, as temporary SQL functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..schema import LANGUAGE_BY_EXTENSION
from .text import DEFAULT_CHARS_PER_TOKEN, ELLIPSIS

FUNCTIONS = {
    "shorten(s STRING, n INT) RETURNS STRING": f"CASE WHEN length(s) > n THEN concat(substring(s, 1, n - 1), '{ELLIPSIS}') ELSE s END",
    "estimated_tokens(s STRING) RETURNS INT": f"greatest(1, CAST(floor(length(s) / {DEFAULT_CHARS_PER_TOKEN}) AS INT))",
    "graph_node_id(scope STRING, fqn STRING) RETURNS STRING": "substring(sha2(concat(scope, ':', fqn), 256), 1, 16)",
    "graph_edge_id(src STRING, kind STRING, dst STRING) RETURNS STRING": "substring(sha2(concat(src, ':', kind, ':', dst), 256), 1, 16)",
    "language_of(extension STRING) RETURNS STRING": "coalesce(CASE lower(extension) " + " ".join(f"WHEN '{e}' THEN '{v}'" for e, v in LANGUAGE_BY_EXTENSION.items()) + " END, 'unknown')",
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]
