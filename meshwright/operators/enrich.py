"""Enrichment: tags from paths and names, change frequency and last commit from a commit log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import importance, with_auto_tags


def file_history(commits: DataFrame) -> DataFrame:
    """(file_path, change_frequency, last_modified_commit) from (commit_idx: 0 is the newest, sha, file_path)."""
    total = commits.agg(F.count_distinct("commit_idx").alias("total"))  # one row
    touched = commits.groupBy("file_path").agg(
        F.count_distinct("commit_idx").alias("n"), F.min_by(F.substring("sha", 1, 8), "commit_idx").alias("last_modified_commit")
    )
    return touched.crossJoin(F.broadcast(total)).select("file_path", (F.col("n") / F.col("total")).alias("change_frequency"), "last_modified_commit")


def enrich(nodes: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """nodes with tags added, and with their file's history where there is a commit log."""
    text = F.concat_ws(" ", F.coalesce("file_path", F.lit("")), "name", "fqn")
    tagged = nodes.withColumn("tags", with_auto_tags(F.col("tags"), text))
    if commits is not None:
        history = file_history(commits).select("file_path", F.col("change_frequency").alias("_f"), F.col("last_modified_commit").alias("_c"))
        tagged = tagged.join(history, "file_path", "left").withColumns(
            {"change_frequency": F.coalesce("_f", F.lit(0.0)), "last_modified_commit": F.coalesce("_c", "last_modified_commit")}
        ).drop("_f", "_c")
    freq = F.coalesce("change_frequency", F.lit(0.0))
    return tagged.withColumn("importance_score", importance(F.coalesce("centrality_score", F.lit(0.0)), freq))
