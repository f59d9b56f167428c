"""Unified diffs as a table of changed line ranges."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

HUNKS = "ord bigint, hunk_id bigint, file_path string, start_line int, end_line int, change_type string, is_new boolean, is_deleted boolean"
_RANGE = re.compile(r"^@@[^@]*?-\d+(?:,(\d+))?[^@]*?\+(\d+)(?:,(\d+))?[^@]*@@")


@dataclass
class ChangedFile:
    path: str | None = None
    is_new: bool = False
    is_deleted: bool = False
    ranges: list[tuple[int, int, str]] = field(default_factory=list)


def _side(line: str, prefix: str) -> str | None:
    target = line[4:].strip()
    return None if target == "/dev/null" else target.removeprefix(prefix)


def parse_diff(text: str) -> list[ChangedFile]:
    """Changed files of a unified diff; one without ranges that is neither new nor deleted is left out.

    Lines of a hunk are counted off by its header, so one that reads like a header isn't taken for it.
    """
    files: list[ChangedFile] = []
    now = ChangedFile()
    left = [0, 0]  # lines of the old and the new side that the open hunk still has
    for line in [*text.splitlines(), "diff --git"]:
        if max(left) > 0 and line[:1] in ("+", "-", " ", "") or line.startswith("\\"):
            if not line.startswith("\\"):
                left[0] -= line[:1] != "+"
                left[1] -= line[:1] != "-"
        elif line.startswith("diff --git"):
            left = [0, 0]
            if now.path is not None and (now.ranges or now.is_new or now.is_deleted):
                files.append(now)
            now = ChangedFile()
        elif line.startswith("new file mode"):
            now.is_new = True
        elif line.startswith("deleted file mode"):
            now.is_deleted = True
        elif line.startswith("+++ "):
            path = _side(line, "b/")
            now.is_deleted |= path is None
            now.path = path or now.path
        elif line.startswith("--- ") and now.path is None:
            now.path = _side(line, "a/")
        elif m := _RANGE.match(line):
            start, count = int(m[2]), int(m[3] or 1)
            left = [int(m[1] or 1), count]
            if count == 0:  # lines are only taken away: the place where they were
                at = max(start, 1)
                now.ranges.append((at, at, "deleted"))
            else:
                kind = "added" if now.is_new else "deleted" if now.is_deleted else "modified"
                now.ranges.append((start, start + count - 1, kind))
    return files


def hunks(spark: SparkSession, text: str) -> DataFrame:
    """HUNKS rows: one for each changed range; for a file without ranges one with null lines."""
    rows = []
    for f in parse_diff(text):
        for start, end, kind in f.ranges or [(None, None, "deleted" if f.is_deleted else "added")]:
            rows.append((len(rows), len(rows), f.path, start, end, kind, f.is_new, f.is_deleted))
    return spark.createDataFrame(rows, HUNKS)
