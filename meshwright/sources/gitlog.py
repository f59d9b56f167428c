"""Commit log of a repository as a table, by the git command."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

COMMITS = "commit_idx bigint, sha string, file_path string"


def parse_log(text: str) -> list[tuple[int, str, str]]:
    """(index from the newest, sha, file) rows of 'git log --name-only --format=%x00%H'."""
    rows = []
    for i, entry in enumerate(text.split("\0")[1:]):
        sha, *files = entry.strip().splitlines()
        rows += [(i, sha, f) for f in files if f]
    return rows


def commits(spark: SparkSession, root: str | Path, limit: int = 500) -> DataFrame | None:
    """The last limit commits' files; None where there is no git history."""
    try:
        out = subprocess.run(["git", "-C", str(root), "log", f"-{limit}", "--name-only", "--relative", "--format=%x00%H"], capture_output=True, text=True, check=True, timeout=120)
    except (OSError, subprocess.SubprocessError):
        return None
    rows = parse_log(out.stdout)
    return spark.createDataFrame(rows, COMMITS) if rows else None
