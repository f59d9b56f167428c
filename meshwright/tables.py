"""Intermediate tables kept in the shared folder, so that a lost executor loses no lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. A local session without it gets its own; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set: executors need a shared folder for intermediate tables")
        named = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="meshwright-")
        shared_dir.own = named
    return named.rstrip("/")


#: Bytes of a small table that one task writes.
BYTES_A_FILE = 2 << 20


def materialize(df: DataFrame, rows: int | None = None, row_bytes: int = 100) -> DataFrame:
    """Write df as Parquet and read it back: a reliable, columnar checkpoint that cuts lineage.

    rows: about how many it has at most, if that is known, of about row_bytes each. A small table is
    then written by few tasks, whatever the number of shuffle partitions, since each file has its price.
    """
    if rows is not None:
        df = df.coalesce(max(1, -(-rows * row_bytes // BYTES_A_FILE)))
    path = f"{shared_dir(df.sparkSession)}/meshwright/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _kept.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows among which one task drops repeats, some 100 bytes each.
ROWS_A_TASK = 500_000


def distinct_by(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df without repeated rows, of about rows at most, dealt by columns to tasks whose number grows with them.

    Shuffled bytes are few where values repeat or are near each other, so tasks that are cut by bytes may have to hold many rows.
    """
    return df.repartition(max(1, -(-rows // ROWS_A_TASK)), *by).distinct()


#: Parts into which the rows of a key are dealt before they are counted.
SALTS = 16


def counts_by(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """(by.., n): the rows of each key of df, which has about rows; the tasks' number grows with them, and the rows of a frequent key go to several."""
    tasks = max(1, -(-rows // ROWS_A_TASK))
    dealt = df.select(*by, F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).alias("_salt")).repartition(tasks, *by, "_salt")
    parts = dealt.groupBy(*by, "_salt").agg(F.count("*").alias("n"))
    return parts.repartition(tasks, *by).groupBy(*by).agg(F.sum("n").alias("n"))


#: Rows of a bucket, beyond which there are more buckets than shuffle partitions.
ROWS_A_BUCKET = 2_000_000


def materialize_by(df: DataFrame, *key: str, rows: int = 0) -> DataFrame:
    """As materialize(), dealt by key into buckets, so that joins on the key of tables written so don't shuffle them.

    rows: about how many the largest of the tables that are to meet has; these must name the same.
    """
    spark = df.sparkSession
    name = f"meshwright_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/meshwright/{name}"
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_BUCKET))
    df.repartition(buckets, *key).write.format("parquet").option("path", path).bucketBy(buckets, *key).saveAsTable(name)
    _kept.append(path)
    _tables.append(name)
    return spark.table(name)


def discard(df: DataFrame) -> None:
    """Delete the intermediate table that df is, once nothing reads it any more."""
    for name in {f.rsplit("/", 2)[1] for f in df.inputFiles()}:
        for path in [p for p in _kept if p.endswith(f"/{name}")]:
            if name in _tables:
                _tables.remove(name)
                df.sparkSession.sql(f"DROP TABLE {name}")
            _kept.remove(path)
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))


_kept: list[str] = []
_tables: list[str] = []


def release(spark: SparkSession) -> int:
    """Delete every table that materialize() has written; call it once results are stored. Returns how many."""
    n = 0
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    while _kept:
        n += _delete(spark, _kept.pop())
    return n
