"""The JSON mirror of a graph: nodes and edges as lines, written whole and swapped in."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework import schema
from latticework.operators.merge import canonical


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def export(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Writes both sets in canonical order beside the path, then renames; a reader sees the old mirror or the new one."""
    spark = nodes.sparkSession
    next_path = f"{path}.{uuid.uuid4().hex}"
    n, e = canonical(nodes, edges)
    n.write.json(f"{next_path}/nodes")
    e.withColumn("confidence", F.col("confidence").cast("double")).write.json(f"{next_path}/edges")
    new, fs = _path(spark, next_path)
    old, _ = _path(spark, path)
    fs.delete(old, True)
    fs.rename(new, old)


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a mirror. Rows without an id, a type or ends, and ones that are not JSON, are skipped."""
    nodes = spark.read.schema(schema.NODE).option("mode", "DROPMALFORMED").json(f"{path}/nodes").where("id IS NOT NULL AND type IS NOT NULL")
    edges = spark.read.schema(schema.EDGE).option("mode", "DROPMALFORMED").json(f"{path}/edges").where("src IS NOT NULL AND dst IS NOT NULL AND type IS NOT NULL")
    return nodes, edges.withColumn("confidence", F.coalesce("confidence", F.lit(1).cast("decimal(9,8)")))
