"""Files to nodes, raw edges and errors: one parser per language, run where the files are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import NODES, RAW_EDGES
from . import python_code, typescript_code
from .builder import Builder

Parser = Callable[[Builder, str], None]


def parse_config(build: Builder, source: str) -> None:
    """One ConfigFile node, from the first line to the last; keys aren't read."""
    node = build.node("ConfigFile", name=build.rel_path.rsplit("/", 1)[-1], fqn=f"{build.rel_path}:config", lines=(1, source.count("\n") + 1), format=build.language)
    build.contains(build.file_id, node)


#: Languages with a parser; others, Markdown among them, give no nodes. Extend it to add a language.
PARSERS: dict[str, Parser] = {
    "python": python_code.parse, "typescript": typescript_code.parse, "javascript": typescript_code.parse,
    "json": parse_config, "yaml": parse_config, "toml": parse_config,
}
PARSED = T.StructType([
    T.StructField("repo_id", T.StringType()), T.StructField("rel_path", T.StringType()),
    T.StructField("nodes", T.ArrayType(NODES)), T.StructField("edges", T.ArrayType(RAW_EDGES)), T.StructField("errors", T.ArrayType(T.StringType())),
    T.StructField("size_bytes", T.LongType()), T.StructField("modified_ns", T.LongType()), T.StructField("content_hash", T.StringType()),
])


def parse_one(parsers: dict[str, Parser], repo_id: str, rel_path: str, language: str, extension: str, size: int, content: bytes, content_hash: str) -> Builder:
    """A parser that fails leaves an error and what it had found."""
    build = Builder(repo_id, rel_path, language, extension, int(size), content_hash)
    try:
        parsers[language](build, bytes(content).decode("utf-8", "replace"))
    except Exception as e:  # noqa: BLE001  one file must not stop the others
        build.errors.append(f"{type(e).__name__}: {e}")
    return build


def parse_files(files: DataFrame, parsers: dict[str, Parser] = PARSERS) -> DataFrame:
    """(repo_id, rel_path, nodes, edges, errors, and what names the file's content): a row for each file whose language has a parser."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            built = [parse_one(parsers, *r[:-1]) for r in part.itertuples(index=False, name=None)]
            yield pd.DataFrame({
                "repo_id": part["repo_id"], "rel_path": part["rel_path"], "nodes": [b.nodes for b in built], "edges": [b.edges for b in built], "errors": [b.errors for b in built],
                "size_bytes": part["size_bytes"], "modified_ns": part["modified_ns"], "content_hash": part["content_hash"],
            })

    wanted = files.filter(F.col("language").isin(*parsers)).select("repo_id", "rel_path", "language", "extension", "size_bytes", "content", "content_hash", "modified_ns")
    return wanted.mapInPandas(run, PARSED)


def nodes_of(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.inline("nodes"))


def raw_edges_of(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.inline("edges"))
