"""The contract queries: thin projections of the operators over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, language, line_dedup, minhash, mixing, quality_model, quality_rules, resampling, simhash, topk, toxicity, whitening
from .common import read


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_quality(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def tokenizer_path() -> str:
    """The vocabulary that the contract names; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), tokenizer_path(), keep=["doc_id"])


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id bigint, turn bigint, role string, text string")
    return chat.format_digests(table.unionByName(extra), tokenizer_path())


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
held AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT doc_id, pos, line, held.k IS NOT NULL AND doc_id <> keeper AS gone
  FROM keyed LEFT JOIN held USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken", F.coalesce("first_slot", F.lit(-1)).alias("first_slot"))


#: The same mix without buckets and parts: one window per order, targets in closed form (the first
#: source by cap over weight that the rest's level leaves uncapped gives the level).
OP9_SQL = """
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('17:' || doc_id::VARCHAR), 1, 15))::BIGINT AS u FROM documents),
total AS (SELECT sum(size)::BIGINT AS t FROM sizes),
shape AS (SELECT t, 256::BIGINT AS b FROM total),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src,
         [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM sizes GROUP BY source),
lev AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
         (t - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY source_size / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY source_size / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM per, total),
tar AS (SELECT *, least(cap, (SELECT max(level) FROM lev WHERE level <= cap / w) * w) AS target FROM lev),
src AS (
  SELECT *, round(target)::BIGINT AS quota, coalesce(sum(target) OVER (ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(target) OVER () AS lo,
         sum(target) OVER (ORDER BY src ROWS UNBOUNDED PRECEDING) / sum(target) OVER () AS hi FROM tar),
points AS (SELECT slot, slot * 0.6180339887498949::DOUBLE - floor(slot * 0.6180339887498949::DOUBLE) AS x FROM (SELECT unnest(range(0, (t + b - 1) // b)) AS slot FROM shape)),
slots AS (SELECT src, slot, row_number() OVER (PARTITION BY src ORDER BY slot) - 1 AS r FROM points JOIN src ON x >= lo AND x < hi),
stream AS (
  SELECT doc_id, size, s.*, coalesce(sum(size) OVER (PARTITION BY src ORDER BY u, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sizes z JOIN src s ON z.source IS NOT DISTINCT FROM s.source),
cut AS (
  SELECT doc_id, src, e * source_size + start AS a, least(e * source_size + start + size, quota) AS z
  FROM stream, (VALUES (0), (1), (2)) v(e) WHERE size > 0 AND e * source_size + start < quota),
parts AS (SELECT doc_id, src, a, z, unnest(range((a // b)::BIGINT, ((z - 1) // b + 1)::BIGINT)) AS r FROM cut, shape),
took AS (
  SELECT doc_id, sum(least(z, (p.r + 1) * b) - greatest(a, p.r * b))::BIGINT AS taken, min(coalesce(slot, (t + b - 1) // b + p.r))::BIGINT AS first_slot
  FROM parts p CROSS JOIN shape LEFT JOIN slots s ON s.src = p.src AND s.r = p.r GROUP BY doc_id)
SELECT doc_id, size, source_size, round(target, 3) AS target, coalesce(taken, 0)::BIGINT AS taken, coalesce(first_slot, -1)::BIGINT AS first_slot FROM stream LEFT JOIN took USING (doc_id)
"""


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("text"), max_n=1, buckets=10_000, seed=2024, min_words=20, share=(10, 100))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 by its table, over the bytes of each distinct word.
OP11_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT i AS n, i::UBIGINT AS v, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY n) AS t FROM steps WHERE k = 8),
found AS (
  SELECT 0 AS target, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
words AS (
  SELECT target, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM found),
vocabulary AS (
  SELECT w, list_transform(range(1, len(hex(w)) + 1, 2), lambda i: ('0x' || hex(w)[i:i + 1])::UBIGINT) AS bytes FROM (SELECT DISTINCT w FROM words)),
hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda a, b: xor(t[(xor(a, b) & 255)::BIGINT + 1], a >> 8)), 4294967295::UBIGINT) % 10000 AS bucket
  FROM vocabulary, crc),
counted AS (
  SELECT bucket, (count(*) FILTER (WHERE target = 0))::DOUBLE AS s, (count(*) FILTER (WHERE target = 1))::DOUBLE AS t FROM words JOIN hashed USING (w) GROUP BY bucket),
total AS (SELECT sum(s) AS ss, sum(t) AS tt FROM counted),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000))))::BIGINT AS gain FROM counted, total),
weighed AS (
  SELECT id AS doc_id, count(*)::BIGINT AS n_features, sum(gain)::BIGINT AS weight FROM words JOIN hashed USING (w) JOIN gains USING (bucket) WHERE target = 0 GROUP BY id),
scored AS (
  SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
  FROM documents LEFT JOIN weighed USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * (SELECT count(*) FROM placed) // 100 THEN place END::BIGINT AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), width=2, least=(4, 5))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


#: Every link, without bands: of two sets that are similar enough, each has one of the other's among its rarest fifth and one.
OP12_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, s, len(s) AS n FROM (
    SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words)),
grams AS (SELECT doc_id, n, unnest(s) AS g FROM sets),
often AS (SELECT g, count(*) AS f FROM grams GROUP BY g),
placed AS (SELECT doc_id, n, g, row_number() OVER (PARTITION BY doc_id ORDER BY f, g) AS r FROM grams JOIN often USING (g)),
rare AS (SELECT doc_id, n, g FROM placed WHERE r <= n - (4 * n + 4) // 5 + 1),
pairs AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM rare a JOIN rare b USING (g) WHERE a.doc_id < b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
links AS (
  SELECT a, b FROM pairs JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 180 * len(list_intersect(x.s, y.s)) >= 80 * (x.n + y.n)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, ends.b FROM reach JOIN ends ON reach.b = ends.a)
SELECT doc_id, n::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=8)


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier, "op5_language_id": op5_language_id, "op6_toxicity": op6_toxicity,
    "op2_simhash_dedup": op2_simhash_dedup, "op3_bpe_round_trip": op3_bpe_round_trip,
    "op7_quality_rules": op7_quality_rules,
    "op4_exact_topk": op4_exact_topk, "op10_chat_format": op10_chat_format, "op8_line_dedup": op8_line_dedup, "op9_mix_sources": op9_mix_sources,
    "op11_importance_resampling": op11_importance_resampling, "op12_minhash_dedup": op12_minhash_dedup, "op13_embedding_whitening": op13_embedding_whitening,
}
ORACLE_SQL = {"op4_exact_topk": OP4_SQL, "op8_line_dedup": OP8_SQL, "op9_mix_sources": OP9_SQL, "op11_importance_resampling": OP11_SQL, "op12_minhash_dedup": OP12_SQL}
