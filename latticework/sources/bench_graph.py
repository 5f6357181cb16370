"""A property graph from relational tables.

Customers are routes, orders methods, parts models, brands tables, suppliers events; items of an order become its accesses
to tables, its uses of models and its dispatches. Every contribution keeps a place (seq), by which merges that take the first
value decide.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework import schema


@dataclass
class Graph:
    nodes: DataFrame  # id, type, label, name, file, line, end_line
    edges: DataFrame  # src, dst, type, confidence (merged)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), *(p if i == 0 else F.concat(F.lit("."), p) for i, p in enumerate(parts)))


def _choice(value: Column, cases: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for k, v in cases.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out.cast(schema.EDGE_CONFIDENCE)


def _edge(df: DataFrame, src: Column, dst: Column, kind: Column | str, confidence: Column | str) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    confidence = F.lit(confidence) if isinstance(confidence, str) else confidence
    return df.select(src.alias("src"), dst.alias("dst"), kind.alias("type"), confidence.cast(schema.EDGE_CONFIDENCE).alias("confidence"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    none, number = F.lit(None).cast("string"), F.lit(None).cast("int")

    def rows(df: DataFrame, key: Column, kind: str, label: Column, name: Column, file: Column = none, line: Column = number, end: Column = number) -> DataFrame:
        return df.select(key.alias("id"), F.lit(kind).alias("type"), label.alias("label"), name.alias("name"), file.alias("file"), line.alias("line"), end.alias("end_line"))

    orders, part = read(spark, sf_dir, "orders"), read(spark, sf_dir, "part")
    line = (F.col("o_orderkey") % 500 + 1).cast("int")
    brands, columns = part.select("p_brand").distinct(), part.select("p_brand", "p_type").distinct()
    out = rows(read(spark, sf_dir, "customer"), _id("route", text("c_custkey")), "route", F.col("c_name"), F.col("c_name"))
    for more in (
        rows(orders, _id("method", text("o_orderkey")), "method", _id("method", text("o_orderkey")), none, F.concat(F.lit("app/"), "o_orderstatus", F.lit(".src")), line, (line + F.col("o_orderkey") % 40).cast("int")),
        rows(part, _id("model", text("p_partkey")), "model", F.col("p_name"), F.col("p_name")),
        rows(brands, _id("table", F.col("p_brand")), "table", F.col("p_brand"), F.col("p_brand")),
        rows(columns, _id("column", F.col("p_brand"), F.col("p_type")), "column", F.col("p_type"), F.col("p_type")),
        rows(read(spark, sf_dir, "supplier"), _id("event", text("s_suppkey")), "event", F.col("s_name"), F.col("s_name")),
    ):
        out = out.unionByName(more)
    return out


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as they are found, several of one identity possible."""
    text = lambda c: F.col(c).cast("string")
    orders, part, item = (read(spark, sf_dir, t) for t in ("orders", "part", "lineitem"))
    method = _id("method", text("o_orderkey"))
    following = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    calls = orders.select("o_orderkey", F.col("o_orderpriority").substr(1, 1).alias("p"), following.alias("next")).where("next IS NOT NULL")
    of_item = _id("method", text("l_orderkey"))
    branded = item.join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    first = item.where("l_linenumber = 1")
    out = _edge(orders, _id("route", text("o_custkey")), method, "routes_to", _choice(F.col("o_orderstatus"), {"F": "1.00", "O": "0.90"}, "0.75"))
    for more in (
        _edge(calls, method, _id("method", text("next")), "calls", _choice(F.col("p"), {"1": "1.00", "2": "0.95", "3": "0.90", "4": "0.85"}, "0.75")),
        _edge(branded, of_item, _id("table", F.col("p_brand")), F.when(F.col("l_returnflag") == "N", "writes").otherwise("reads"), F.round(1 - F.col("l_discount"), 2).cast("decimal(3,2)")),
        _edge(item, of_item, _id("model", text("l_partkey")), "uses_model", "0.9"),
        _edge(part, _id("model", text("p_partkey")), _id("table", F.col("p_brand")), "uses_table", "1"),
        _edge(part.select("p_brand", "p_type").distinct(), _id("table", F.col("p_brand")), _id("column", F.col("p_brand"), F.col("p_type")), "has_column", "1"),
        _edge(first, of_item, _id("event", text("l_suppkey")), "dispatches", "0.9"),
        _edge(item.groupBy("l_suppkey").agg(F.min("l_orderkey").alias("o")), _id("event", text("l_suppkey")), _id("method", text("o")), "handled_by", "0.95"),
    ):
        out = out.unionByName(more)
    return out


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    from latticework.operators.merge import merge_edges

    return Graph(nodes(spark, sf_dir), merge_edges(contributions(spark, sf_dir)))


#: The same graph in SQL, for comparison: common table expressions nodes, raw_edges and edges.
SQL = """
nodes AS (
  SELECT 'route:' || c_custkey AS id, 'route' AS type, c_name AS label, c_name AS name, CAST(NULL AS VARCHAR) AS file, CAST(NULL AS INTEGER) AS line, CAST(NULL AS INTEGER) AS end_line FROM customer
  UNION ALL SELECT 'method:' || o_orderkey, 'method', 'method:' || o_orderkey, NULL, 'app/' || o_orderstatus || '.src', CAST(o_orderkey % 500 + 1 AS INTEGER), CAST(o_orderkey % 500 + 1 + o_orderkey % 40 AS INTEGER) FROM orders
  UNION ALL SELECT 'model:' || p_partkey, 'model', p_name, p_name, NULL, NULL, NULL FROM part
  UNION ALL SELECT DISTINCT 'table:' || p_brand, 'table', p_brand, p_brand, NULL, NULL, NULL FROM part
  UNION ALL SELECT DISTINCT 'column:' || p_brand || '.' || p_type, 'column', p_type, p_type, NULL, NULL, NULL FROM part
  UNION ALL SELECT 'event:' || s_suppkey, 'event', s_name, s_name, NULL, NULL, NULL FROM supplier
), raw_edges AS (
  SELECT 'route:' || o_custkey AS src, 'method:' || o_orderkey AS dst, 'routes_to' AS type, CAST(CASE o_orderstatus WHEN 'F' THEN 1.00 WHEN 'O' THEN 0.90 ELSE 0.75 END AS DECIMAL(9,8)) AS confidence FROM orders
  UNION ALL SELECT 'method:' || o_orderkey, 'method:' || nxt, 'calls', CASE p WHEN '1' THEN 1.00 WHEN '2' THEN 0.95 WHEN '3' THEN 0.90 WHEN '4' THEN 0.85 ELSE 0.75 END
    FROM (SELECT o_orderkey, substr(o_orderpriority, 1, 1) AS p, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders) WHERE nxt IS NOT NULL
  UNION ALL SELECT 'method:' || l_orderkey, 'table:' || p_brand, CASE WHEN l_returnflag = 'N' THEN 'writes' ELSE 'reads' END, CAST(round(1 - l_discount, 2) AS DECIMAL(3,2)) FROM lineitem JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT 'method:' || l_orderkey, 'model:' || l_partkey, 'uses_model', 0.9 FROM lineitem
  UNION ALL SELECT 'model:' || p_partkey, 'table:' || p_brand, 'uses_table', 1 FROM part
  UNION ALL SELECT DISTINCT 'table:' || p_brand, 'column:' || p_brand || '.' || p_type, 'has_column', 1 FROM part
  UNION ALL SELECT 'method:' || l_orderkey, 'event:' || l_suppkey, 'dispatches', 0.9 FROM lineitem WHERE l_linenumber = 1
  UNION ALL SELECT 'event:' || l_suppkey, 'method:' || min(l_orderkey), 'handled_by', 0.95 FROM lineitem GROUP BY l_suppkey
), edges AS (
  SELECT src, dst, type, max(confidence) AS confidence FROM raw_edges GROUP BY src, dst, type
)
"""
