"""A property graph derived from the relational test tables, by one SQL text that both engines run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import distinct_by

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations")

_LANG = "CASE CAST({k} % 3 AS INT) WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' ELSE 'json' END"
_NODE = "SELECT '{p}' || CAST({k} AS STRING) AS node_id, '{t}' AS node_type, {name} AS name, {fqn} AS fqn, " + _LANG + " AS language, {path} AS file_path, {doc} AS docstring, {tags} AS tags, CAST({imp} AS DOUBLE) AS importance_score, CAST({cen} AS DOUBLE) AS centrality_score, CAST({sl} AS INT) AS start_line, CAST({el} AS INT) AS end_line, 'repo' || CAST({k} % 2 AS STRING) AS repo_id FROM {src}"
_NATION = "nation JOIN region ON n_regionkey = r_regionkey"


def nodes_sql(array: str = "array({})") -> str:
    """array: how the dialect writes an array of expressions."""
    def node(p, t, k, src, name, fqn, path="NULL", doc="''", tags=(), imp="0", cen="0", sl="0", el="0"):
        items = ", ".join(tags)
        return _NODE.format(p=p, t=t, k=k, src=src, name=name, fqn=fqn, path=f"CAST({path} AS STRING)", doc=doc, tags=array.format(items) if items else array.format("'none'"), imp=imp, cen=cen, sl=sl, el=el)

    place = "r_name || '/' || n_name"
    return " UNION ALL ".join([
        node("r", "Directory", "r_regionkey", "region", "r_name", "r_name"),
        node("n", "File", "n_nationkey", _NATION, "n_name", "r_name || '.' || n_name", place, imp="n_nationkey / 25e0"),
        node("f", "ConfigFile", "n_nationkey", _NATION, "n_name || '.toml'", "r_name || '.' || n_name || ':config'", place, tags=("c_tag",), imp="n_nationkey / 50e0").replace("c_tag", "CASE WHEN n_nationkey % 3 = 0 THEN 'BUILDING' WHEN n_nationkey % 3 = 1 THEN 'MACHINERY' ELSE 'other' END"),
        node("c", "Class", "c_custkey", f"{_NATION} JOIN customer ON c_nationkey = n_nationkey", "c_name", "r_name || '.' || n_name || '.' || c_name", place,
             "'account of ' || c_name || ' in ' || n_name", ("c_mktsegment", "n_name"), "c_acctbal / 10000e0", "(c_custkey % 97) / 97e0", "(c_custkey % 50) * 10 + 1", "(c_custkey % 50) * 10 + 12"),
        node("s", "Interface", "s_suppkey", f"{_NATION} JOIN supplier ON s_nationkey = n_nationkey", "s_name", "r_name || '.' || n_name || '.' || s_name", place,
             "'supplier ' || s_name", ("r_name",), "s_acctbal / 10000e0", "(s_suppkey % 89) / 89e0", "(s_suppkey % 50) * 10 + 3", "(s_suppkey % 50) * 10 + 5"),
        node("o", "Function", "o_orderkey", "orders", "'o' || CAST(o_orderkey AS STRING)", "'orders.o' || CAST(o_orderkey AS STRING)", "'orders/p' || CAST(o_orderkey % 40 AS STRING)",
             "'order with priority ' || o_orderpriority", ("o_orderstatus", "o_orderpriority"), "o_totalprice / 1000000e0", "(o_orderkey % 101) / 101e0", "o_orderkey % 400", "o_orderkey % 400 + o_orderkey % 7"),
        node("p", "DbModel", "p_partkey", "part", "p_name", "'parts.' || p_name", "'parts/' || p_brand", "p_type", ("p_brand", "p_type"), "p_retailprice / 10000e0", "(p_partkey % 83) / 83e0", "p_partkey % 300", "p_partkey % 300 + 4"),
    ])


def _edge(t: str, src: str, dst: str, frm: str, distinct: bool = False) -> str:
    return f"SELECT {'DISTINCT ' if distinct else ''}'{t}' AS edge_type, {src} AS src_id, {dst} AS dst_id FROM {frm}"


def _id(prefix: str, key: str) -> str:
    return f"'{prefix}' || CAST({key} AS STRING)"


#: Cycles between customers: whose urgent order is followed by whose.
_SUCCESSORS_SQL = _edge("IMPORTS", _id("c", "o1.o_custkey"), _id("c", "o2.o_custkey"), "orders o1 JOIN orders o2 ON o2.o_orderkey = o1.o_orderkey + 1 WHERE o1.o_orderpriority = '1-URGENT' AND o1.o_custkey <> o2.o_custkey", True)
EDGES_SQL = " UNION ALL ".join([
    _edge("CONTAINS", _id("r", "n_regionkey"), _id("n", "n_nationkey"), "nation"),
    _edge("CONTAINS", _id("n", "c_nationkey"), _id("c", "c_custkey"), "customer"),
    _edge("CONTAINS", _id("n", "s_nationkey"), _id("s", "s_suppkey"), "supplier"),
    _edge("CALLS", _id("c", "o_custkey"), _id("o", "o_orderkey"), "orders"),
    _edge("CALLS", _id("o", "l_orderkey"), _id("s", "l_suppkey"), "lineitem", True),
    _edge("READS_FROM", _id("o", "l_orderkey"), _id("p", "l_partkey"), "lineitem WHERE l_returnflag <> 'R'", True),
    _edge("WRITES_TO", _id("o", "l_orderkey"), _id("p", "l_partkey"), "lineitem WHERE l_returnflag = 'R'", True),
    _edge("IMPLEMENTS", _id("s", "l_suppkey"), _id("p", "l_partkey"), "lineitem", True),
    _SUCCESSORS_SQL,
])


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for t in names or TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "region", "nation", "customer", "supplier", "part", "orders")
    return spark.sql(nodes_sql())


def edges(spark: SparkSession, sf_dir: str, repeats: bool = False) -> DataFrame:
    """The rows of EDGES_SQL. Repeated pairs are dropped while they are numbers, by as many tasks as the table asks for.

    repeats: leave those among the lines of an order, of which it has few, for what doesn't tell an edge from several of its kind.
    """
    views(spark, sf_dir, "nation", "customer", "supplier", "orders", "lineitem")
    nation, customer, supplier, orders, lineitem = map(spark.table, ("nation", "customer", "supplier", "orders", "lineitem"))
    ordered, lines = orders.count(), lineitem.count()
    following = orders.select((F.col("o_orderkey") - 1).alias("at"), F.col("o_custkey").alias("next"))
    urgent = orders.filter("o_orderpriority = '1-URGENT'").join(following, F.col("o_orderkey") == F.col("at")).filter("o_custkey <> next")

    def text(edge_type: str, src: str, a: str, dst: str, b: str, pairs: DataFrame) -> DataFrame:
        named = lambda prefix, key: F.concat(F.lit(prefix), F.col(key).cast("string"))
        return pairs.select(F.lit(edge_type).alias("edge_type"), named(src, a).alias("src_id"), named(dst, b).alias("dst_id"))

    def once(edge_type: str, src: str, a: str, dst: str, b: str, pairs: DataFrame, rows: int) -> DataFrame:
        return text(edge_type, src, a, dst, b, pairs if repeats and src == "o" else distinct_by(pairs.select(a, b), rows, a, b))

    return reduce(DataFrame.unionByName, [
        text("CONTAINS", "r", "n_regionkey", "n", "n_nationkey", nation),
        text("CONTAINS", "n", "c_nationkey", "c", "c_custkey", customer),
        text("CONTAINS", "n", "s_nationkey", "s", "s_suppkey", supplier),
        text("CALLS", "c", "o_custkey", "o", "o_orderkey", orders),
        once("CALLS", "o", "l_orderkey", "s", "l_suppkey", lineitem, lines),
        once("READS_FROM", "o", "l_orderkey", "p", "l_partkey", lineitem.filter("l_returnflag <> 'R'"), lines),
        once("WRITES_TO", "o", "l_orderkey", "p", "l_partkey", lineitem.filter("l_returnflag = 'R'"), lines),
        once("IMPLEMENTS", "s", "l_suppkey", "p", "l_partkey", lineitem, lines),
        once("IMPORTS", "c", "o_custkey", "c", "next", urgent, ordered),
    ])


#: Letters of the nodes that edges have, in their order.
_KINDS = "cnoprs"
#: Keys that fit a number with the place of their letter.
_LEAST, _MOST = -(1 << 60), (1 << 60) - 1
#: Keys of the tables that edges are of.
_KEYS = {"nation": ("n_regionkey", "n_nationkey"), "customer": ("c_nationkey", "c_custkey"), "supplier": ("s_nationkey", "s_suppkey"), "orders": ("o_custkey", "o_orderkey"), "lineitem": ("l_orderkey", "l_suppkey", "l_partkey")}


def links(spark: SparkSession, sf_dir: str, *types: str) -> DataFrame:
    """(src_id, dst_id) of the edges of some types, or of all, repeats included; each table is read once and the lines of orders aren't shuffled.

    A node is a number, eight times its key and the place of its letter, which node_name() turns to
    text; it is a text already if a key is too large for that.
    """
    views(spark, sf_dir, *_KEYS)
    tables = {t: spark.table(t) for t in _KEYS}
    wanted = lambda *names: not types or any(n in types for n in names)
    keys = reduce(DataFrame.unionByName, [t.select(F.explode(F.array(*(F.col(k).cast("long") for k in _KEYS[name]))).alias("key")) for name, t in tables.items()])
    fits = F.coalesce(F.bool_and(F.col("key").between(_LEAST, _MOST)), F.lit(True))
    numbers = keys.agg(fits).first()[0]

    def end(kind: str, key: str) -> Column:
        return F.col(key).cast("long") * 8 + _KINDS.index(kind) if numbers else F.concat(F.lit(kind), F.col(key).cast("string"))

    def pair(src: str, a: str, dst: str, b: str) -> Column:
        return F.struct(end(src, a).alias("src_id"), end(dst, b).alias("dst_id"))

    found = []
    if wanted("CONTAINS"):
        found += [tables[t].select(pair(*ends).alias("link")) for t, ends in (("nation", ("r", "n_regionkey", "n", "n_nationkey")), ("customer", ("n", "c_nationkey", "c", "c_custkey")), ("supplier", ("n", "s_nationkey", "s", "s_suppkey")))]
    if wanted("CALLS"):
        found.append(tables["orders"].select(pair("c", "o_custkey", "o", "o_orderkey").alias("link")))
    of_line = [pair("o", "l_orderkey", "s", "l_suppkey")] if wanted("CALLS") else []
    if wanted("IMPLEMENTS"):
        of_line.append(pair("s", "l_suppkey", "p", "l_partkey"))
    for name, flag in (("READS_FROM", "l_returnflag <> 'R'"), ("WRITES_TO", "l_returnflag = 'R'")):
        if wanted(name):
            of_line.append(F.when(F.expr(flag), pair("o", "l_orderkey", "p", "l_partkey")))
    if of_line:
        found.append(tables["lineitem"].select(F.explode(F.array(*of_line)).alias("link")).filter("link IS NOT NULL"))
    if wanted("IMPORTS"):
        following = tables["orders"].select((F.col("o_orderkey") - 1).alias("at"), F.col("o_custkey").alias("next"))
        urgent = tables["orders"].filter("o_orderpriority = '1-URGENT'").join(following, F.col("o_orderkey") == F.col("at")).filter("o_custkey <> next")
        found.append(urgent.select(pair("c", "o_custkey", "c", "next").alias("link")))
    return reduce(DataFrame.unionByName, found).select("link.*")


def node_name(df: DataFrame, column: str) -> DataFrame:
    """df with the text of a node of links()."""
    if df.schema[column].dataType.simpleString() != "bigint":
        return df
    letter = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col(column).bitwiseAND(7) + 1).cast("int"))
    return df.withColumn(column, F.concat(letter, F.shiftright(column, 3).cast("string")))


def sorts_first(df: DataFrame, a: str, b: str) -> Column:
    """Whether the text of node a of links() sorts before that of b."""
    if df.schema[a].dataType.simpleString() != "bigint":
        return F.col(a) < F.col(b)
    kind, key = (lambda c: F.col(c).bitwiseAND(7)), (lambda c: F.shiftright(c, 3).cast("string"))
    return F.when(kind(a) != kind(b), kind(a) < kind(b)).otherwise(key(a) < key(b))


def near(df: DataFrame):
    """What 512 neighbouring keys of nodes of links() have in common; None where they are texts."""
    return (lambda c: F.shiftright(c, 12)) if df.schema["src_id"].dataType.simpleString() == "bigint" else None



#: Tables whose rows edges of a type are of, those of all types included.
_ROWS_OF = {"CALLS": ("orders", "lineitem"), "IMPORTS": ("orders",), None: ("customer", "supplier", "orders", "orders", "lineitem", "lineitem", "lineitem")}


def most_edges(spark: SparkSession, sf_dir: str, edge_type: str | None = None) -> int:
    """About how many edges of the type, or in all, there are at most: the rows that they are of."""
    return sum(spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in _ROWS_OF[edge_type])
