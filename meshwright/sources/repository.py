"""Repository scan as a Spark data source: a folder tree's files as rows, read by the executors.

    spark.dataSource.register(RepositorySource)
    spark.read.format("repository").option("path", root).load()

The driver opens the topmost folders only; tasks list what is below, and read. On a cluster the folder
must be mounted on the driver and the executors alike. Built-in file sources skip names that begin
with '_' or '.', which would lose __init__.py.
"""

from __future__ import annotations

import fnmatch
import hashlib
import os
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import FILES, LANGUAGE_BY_EXTENSION, LISTED

# Folders never entered, and the default patterns.
SKIPPED_FOLDERS = frozenset((
    ".git", "__pycache__", "node_modules", ".venv", "venv", ".mypy_cache", ".ruff_cache", ".pytest_cache", "dist", "build", "coverage", ".tox", ".eggs",
))
DEFAULT_EXCLUDES = (
    "**/node_modules/**", "**/.git/**", "**/__pycache__/**", "**/dist/**", "**/build/**", "**/.venv/**", "**/venv/**", "**/*.min.js", "**/*.min.css", "**/coverage/**", "**/.pytest_cache/**",
)
MAX_FILE_BYTES = 512 * 1024
FILES_PER_PARTITION = 200
#: Folders that are opened on the driver at most, before tasks list what is below.
SUBTREES = 64


def glob_regex(patterns) -> str:
    """One regular expression for glob patterns in which * also matches slashes. It matches nothing without patterns."""
    parts = [re.escape(p).replace(r"\*", ".*").replace(r"\?", ".") for p in patterns]
    return "(?s)^(?:" + "|".join(parts) + ")$" if parts else r"^\b$"


class Excluder:
    """Configured patterns hold for the relative path or the name; lines of .gitignore for the relative path alone."""

    def __init__(self, root: Path, patterns):
        ignore = root / ".gitignore"
        lines = ignore.read_text(errors="replace").splitlines() if ignore.is_file() else []
        self.patterns = list(patterns)
        self.ignored = [s for x in lines if (s := x.strip()) and not s.startswith("#")]

    def __call__(self, rel: str) -> bool:
        name = rel.rsplit("/", 1)[-1]
        return any(fnmatch.fnmatchcase(rel, p) or fnmatch.fnmatchcase(name, p) for p in self.patterns) or any(fnmatch.fnmatchcase(rel, p) for p in self.ignored)


def opened(root: Path, at: str, excluded: Excluder) -> tuple[list[str], list[str]]:
    """(files, folders) in a folder, by their paths from root: sorted, without those that are excluded. Links to folders aren't followed."""
    files, folders = [], []
    try:
        entries = sorted(os.scandir(root / at), key=lambda e: e.name)
    except OSError:
        return files, folders
    for e in entries:
        rel = f"{at}/{e.name}" if at else e.name
        if e.is_dir():
            if e.name not in SKIPPED_FOLDERS and not e.is_symlink() and not excluded(rel):
                folders.append(rel)
        elif not excluded(rel):
            files.append(rel)
    return files, folders


def walk(root: Path, patterns=DEFAULT_EXCLUDES, at: str = "", excluded: Excluder | None = None) -> Iterator[str]:
    """Relative paths of the files under root, excluded ones left out, folders pruned."""
    excluded = excluded or Excluder(root, patterns)
    files, folders = opened(root, at, excluded)
    yield from files
    for folder in folders:
        yield from walk(root, patterns, folder, excluded)


class Batch(InputPartition):
    """Files by path, and folders whose files a task lists itself."""

    def __init__(self, paths: list[str], folders: list[str] = ()):
        self.paths, self.folders = paths, list(folders)


class RepositoryReader(DataSourceReader):
    def __init__(self, options):
        self.root = Path(options["path"]).resolve()
        self.repo_id = options.get("repo_id", "")
        self.limit = int(options.get("max_file_size_bytes", MAX_FILE_BYTES))
        self.patterns = options["exclude"].split("\n") if options.get("exclude") else DEFAULT_EXCLUDES
        self.only = set(options["only"].split("\n")) if options.get("only") else None
        self.known = {e: n for e, n in LANGUAGE_BY_EXTENSION.items() if self._wanted(options, "extensions", e) and self._wanted(options, "languages", n)}
        self.per_partition = int(options.get("files_per_partition", FILES_PER_PARTITION))
        self.contents = options.get("contents", "true") == "true"

    @staticmethod
    def _wanted(options, key: str, value: str) -> bool:
        return not options.get(key) or value in options[key].lower().split("\n")

    def _listed(self, rel: str) -> bool:
        return Path(rel).suffix.lower() in self.known and (self.only is None or rel in self.only)

    def partitions(self):
        """Folders are opened here until there are enough of them for tasks to go on with."""
        excluded = Excluder(self.root, self.patterns)
        files, folders = [], [""]
        while folders and len(folders) < SUBTREES:
            found, inner = opened(self.root, folders.pop(0), excluded)
            files += filter(self._listed, found)
            folders += inner
        n = self.per_partition
        return [Batch(files[i : i + n]) for i in range(0, len(files), n)] + [Batch([], [f]) for f in folders] or [Batch([])]

    def read(self, partition: Batch):
        excluded = Excluder(self.root, self.patterns) if partition.folders else None
        inner = (rel for folder in partition.folders for rel in walk(self.root, self.patterns, folder, excluded) if self._listed(rel))
        for rel in (*partition.paths, *inner):
            try:
                stat = (self.root / rel).stat()
                if stat.st_size > self.limit:
                    continue
                name = self.repo_id, rel, LANGUAGE_BY_EXTENSION[Path(rel).suffix.lower()], Path(rel).suffix.lower()
                if not self.contents:
                    yield *name, stat.st_size, stat.st_mtime_ns
                    continue
                content = (self.root / rel).read_bytes()
            except OSError:
                continue
            yield *name, len(content), content, hashlib.sha256(content).hexdigest(), stat.st_mtime_ns


class RepositorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self):
        return FILES if self.options.get("contents", "true") == "true" else LISTED

    def reader(self, schema) -> RepositoryReader:
        return RepositoryReader(self.options)


def read_contents(rows: DataFrame, root: str | Path) -> DataFrame:
    """rows (rel_path, listed, ..) with content and content_hash, read where the rows are; null for what isn't listed or can't be read."""
    top = Path(root).resolve()
    names = rows.columns
    schema = T.StructType([*rows.schema, T.StructField("content", T.BinaryType()), T.StructField("content_hash", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, FILES_PER_PARTITION):
                part = batch.slice(i, FILES_PER_PARTITION)
                contents = [_bytes_of(top / rel) if there else None for rel, there in zip(part.column("rel_path").to_pylist(), part.column("listed").to_pylist())]
                hashes = [None if c is None else hashlib.sha256(c).hexdigest() for c in contents]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(contents, type=pa.binary()), pa.array(hashes, type=pa.string())], names=[*names, "content", "content_hash"])

    return rows.mapInArrow(run, schema)


def _bytes_of(path: Path) -> bytes | None:
    try:
        return path.read_bytes()
    except OSError:
        return None


def scan(spark: SparkSession, root: str | Path, repo_id: str = "", **options) -> DataFrame:
    """FILES rows of a repository, or with contents=False LISTED rows, for which no file is opened. exclude, only, extensions, languages: lists of patterns, relative paths and names."""
    spark.dataSource.register(RepositorySource)
    reader = spark.read.format("repository").option("path", str(root)).option("repo_id", repo_id)
    for key, value in options.items():
        if value is not None:
            reader = reader.option(key, "\n".join(value) if isinstance(value, (list, tuple, set)) else str(value).lower() if isinstance(value, bool) else str(value))
    return reader.load()

