"""Questions in plain language to queries: intent, symbols, and a query text."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions.text import intent, symbol_candidates

CANDIDATES, PER_CANDIDATE, ENTITIES, CUTOFF = 5, 2, 3, 0.75
#: Text to a query, e.g. by a language model; an empty answer or an exception falls back to the rules.
Translator = Callable[[str], str]


def classify(spark: SparkSession, question: str) -> tuple[str, list[str]]:
    """(intent, symbol candidates) of one question."""
    row = spark.range(1).select(intent(F.lit(question)).alias("intent"), symbol_candidates(F.lit(question)).alias("words")).first()
    return row.intent, list(row.words)[:CANDIDATES]


def may_be_similar(word: str, name: Column) -> Column:
    """False only for names that are less than CUTOFF alike.

    With M letters in matching blocks the ratio is 2 M / total, total being both lengths. Any two blocks
    lie apart by a letter that doesn't match, of which there are total - 2 M; so blocks are one more at
    most, and hold M less their number, or 3 M - total - 1, pairs of neighbours that the word has too.
    """
    share = CUTOFF / (2 - CUTOFF)
    length = F.length(name)
    pairs = sorted({word[i : i + 2] for i in range(len(word) - 1)})
    places = F.when(length > 1, F.sequence(F.lit(1), F.greatest(length - 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    shared = F.size(F.filter(places, lambda i: F.substr(name, i, F.lit(2)).isin(*pairs)))
    total = length + len(word)
    return length.between(int(len(word) * share), int(len(word) / share) + 1) & (shared >= 3 * F.ceil(total * (CUTOFF / 2)) - total - 1)


def similar_names(nodes: DataFrame, words: list[str]) -> DataFrame:
    """(word, name, ratio): names at least CUTOFF alike by matching blocks.

    Names that can't be as alike aren't compared: those whose lengths aren't within a factor r / (2 - r) of
    each other for a ratio of r, and those that share too few pairs of letters with the word. Each distinct
    name is compared once, in batches where the names are.
    """
    names = nodes.filter(F.coalesce("name", F.lit("")) != "").select("name").distinct()
    near = F.lit(False)
    for w in words:
        near = near | may_be_similar(w, F.col("name"))

    def run(parts):
        for part in parts:
            rows = []
            for w in words:
                match = difflib.SequenceMatcher()
                match.set_seq2(w)
                for name in part["name"]:
                    match.set_seq1(name)
                    if match.real_quick_ratio() >= CUTOFF and match.quick_ratio() >= CUTOFF and (r := match.ratio()) >= CUTOFF:
                        rows.append((w, name, r))
            yield pd.DataFrame(rows, columns=["word", "name", "ratio"])

    return names.filter(near).mapInPandas(run, "word string, name string, ratio double")


def entities(nodes: DataFrame, words: list[str], top: int = ENTITIES) -> list[str]:
    """fqns that the words stand for: of each word two exact names, else the two most alike; each once, in order."""
    if not words:
        return []
    exact: dict[str, list[str]] = {}
    # The first of each word, so that no word's matches crowd out another's: a few rows reach the driver.
    per_name = W.partitionBy("name").orderBy("fqn")
    hits = nodes.filter(F.col("name").isin(words)).select("name", "fqn").distinct()
    for r in hits.withColumn("_n", F.row_number().over(per_name)).filter(F.col("_n") <= PER_CANDIDATE).orderBy("name", "_n").collect():
        exact.setdefault(r.name, []).append(r.fqn)
    fuzzy: dict[str, list[str]] = {}
    if missing := [w for w in words if w not in exact]:
        per_word = W.partitionBy("word").orderBy(F.desc("ratio"), F.desc("name"))
        best = similar_names(nodes, missing).withColumn("_n", F.row_number().over(per_word)).filter(F.col("_n") <= PER_CANDIDATE)
        first = nodes.join(best.select("name"), "name", "left_semi").groupBy("name").agg(F.min("fqn").alias("fqn"))
        for r in best.join(first, "name").orderBy(F.desc("ratio"), F.desc("name")).collect():
            fuzzy.setdefault(r.word, []).append(r.fqn)
    found = [f for w in words for f in (exact.get(w) or fuzzy.get(w, []))[:PER_CANDIDATE]]
    return list(dict.fromkeys(found))[:top]


def by_rule(kind: str, found: list[str]) -> str:
    """A query for an intent and its symbols; empty for a semantic question."""
    first = found[0] if found else "unknown"
    if kind == "path" and len(found) > 1:
        return f'PATH FROM "{found[0]}" TO "{found[1]}"'
    if kind == "impact":
        return f'IMPACT "{first}" DEPTH 3'
    if kind in ("path", "structural"):
        return f'DEPENDENTS "{first}"' if found else "FIND * LIMIT 20"
    return ""


def build(spark: SparkSession, nodes: DataFrame, question: str, translate: Translator | None = None) -> tuple[str, str]:
    """(intent, query)."""
    kind, words = classify(spark, question)
    if translate is not None:
        try:
            if text := translate(question).strip():
                return kind, text
        except Exception:  # noqa: BLE001  a translator may fail in any way; the rules still work
            pass
    return kind, by_rule(kind, entities(nodes, words) if kind != "semantic" else [])
