"""Upserts of nodes and edges, evidence keys, and the overview's summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(value: str, order: str, where: str | None = None) -> Column:
    """The first value by order among the rows where a condition holds (by default, where it is not null)."""
    return F.expr(f"min_by({value}, {order}) FILTER (WHERE {where or f'{value} IS NOT NULL'})")


def merge_nodes(rows: DataFrame, scalars: tuple[str, ...] = ("name", "file", "line")) -> DataFrame:
    """One node for each id: the first non-null value wins; a type of 'unknown' and a label equal to the id give way.

    rows: id, type, label, scalars, sources array<string>, seq (unique within an id).
    """
    kind = F.coalesce(first_by("type", "seq", "type <> 'unknown'"), F.lit("unknown")).alias("type")
    label = F.coalesce(first_by("label", "seq", "label <> id"), F.col("id")).alias("label")
    rest = [first_by(c, "seq").alias(c) for c in scalars]
    sources = F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources")
    return rows.groupBy("id").agg(kind, label, *rest, sources)


def merge_edges(rows: DataFrame) -> DataFrame:
    """One edge for each (src, dst, type), of the greatest confidence; partial sums before the one shuffle."""
    return rows.groupBy("src", "dst", "type").agg(F.max("confidence").alias("confidence"))


def merge_entries(rows: DataFrame, keys: list[str], entry: str, value: str, seq: str) -> DataFrame:
    """Keyed entries (operations, evidence) of edges: the first writer of an entry wins; entries in order of their key."""
    kept = rows.groupBy(*keys, entry).agg(F.min_by(value, seq).alias(value))
    return kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(entry, value))).alias("entries"))


def evidence_key(line: Column, payload: Column) -> Column:
    """Nine digits of the line, a colon, and eight hexadecimal digits of the payload's hash."""
    return F.concat(F.lpad(F.coalesce(line, F.lit(0)).cast("string"), 9, "0"), F.lit(":"), F.substring(F.sha2(payload, 256), 1, 8))


def evidence_json(fields: dict[str, Column]) -> Column:
    """A JSON object of the fields that are neither null nor empty, in the order given."""
    kept = [F.when(c.isNotNull() & (c.cast("string") != ""), F.to_json(F.struct(c.alias(k))).substr(F.lit(2), F.length(F.to_json(F.struct(c.alias(k)))) - 2)) for k, c in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *kept), F.lit("}"))


def canonical(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical orders, for sinks: nodes by (type, id), edges by (src, type, dst)."""
    return nodes.orderBy("type", "id"), edges.orderBy("src", "type", "dst")


def compact_ranked(rows: DataFrame, group: str, value: str, limit: int) -> DataFrame:
    """Of each group: the best row of each value by (confidence falling, depth, id), the top ones of these, by value."""
    best = rows.withColumn("k", F.row_number().over(Window.partitionBy(group, value).orderBy(F.desc("confidence"), "depth", "id"))).where("k = 1")
    top = best.withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("confidence"), "depth", "id"))).withColumn("n", F.count("*").over(Window.partitionBy(group)))
    return top.where(F.col("k") <= limit).groupBy(group).agg(F.array_sort(F.collect_list(value)).alias("values"), (F.max("n") > limit).alias("truncated"))


def overview(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(entity, type, n): node and edge counts by type."""
    count = lambda df, what: df.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(what).alias("entity"), "type", "n")
    return count(nodes, "node").unionByName(count(edges, "edge"))
