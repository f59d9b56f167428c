"""Line dedup against its definition."""

import random

from meshwright.llm import line_dedup
from pyspark.sql import functions as F

LONG = [f"This is shared line number {i} with more than forty characters" for i in range(6)]


def brute(rows, least=5):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))
    holders = {}
    for n, (i, text) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 40:
                holders.setdefault(k, []).append(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        keep = []
        for x in lines:
            ids = holders.get(key(x), [])
            last = max((j for j in ids if j is not None), default=None)
            if len(ids) < least or i == last:
                keep.append(x)
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=repr)


def found(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, k_id string, pos int").repartition(3)
    docs = docs.withColumns({"n_lines": F.lit("clash"), "keep_runs": F.lit(1)})
    got = line_dedup.dedup_lines(docs, **options)
    assert got.columns == ["doc_id", "text", "k_id", "pos", "keep_runs", "n_lines", "n_dropped", "kept_text"]
    assert got.filter("k_id <> 'clash' or pos <> 1 or keep_runs <> 1").count() == 0
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()), key=repr)


def test_random(spark):
    rng = random.Random(2)
    variants = lambda x: rng.choice([x, x.upper(), f" \t{x}\r", x])
    rows = [(i, "\n".join(variants(rng.choice([*LONG, "short", "", "É" * 45, "é" * 45])) for _ in range(rng.randint(0, 6)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "\n\n"), (None, "\n".join(LONG)), (None, LONG[0]), (39, LONG[1]), (39, LONG[1]), (60, "\n".join([LONG[2]] * 400 + ["x"] * 400))]
    assert found(spark, rows) == brute(rows)


def test_null_ids_alone_and_empty(spark):
    rows = [(None, LONG[0])] * 6
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_very_long_texts(spark):
    long = "\n".join(f"{x} {i}" if i % 9 else LONG[0] for i, x in enumerate(["a line of its own that is long enough to count"] * 60_000))
    rows = [(i, LONG[0]) for i in range(5)] + [(3, long), (77, "x" * 2_000_000)]
    assert found(spark, rows) == brute(rows)
