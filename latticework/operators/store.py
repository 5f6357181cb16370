"""Generations: facts addressed by content, fingerprints, manifests, retention."""

from __future__ import annotations

import json
import os
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATOR = "\0"
LOCATION = ("file", "line", "end_line")


def content_hash(kind: str, *payload: Column) -> Column:
    """sha256 over the kind of fact and its payload, with separators that no payload holds."""
    return F.sha2(F.concat_ws(SEPARATOR, F.lit(kind), *(F.coalesce(p.cast("string"), F.lit("")) for p in payload)), 256)


def node_facts(nodes: DataFrame) -> DataFrame:
    """Nodes with content_hash, and semantic_hash, which leaves out where they stand."""
    every = [F.col(c) for c in ("id", "type", "label", "name", *LOCATION)]
    return nodes.withColumn("content_hash", content_hash("node", *every)).withColumn("semantic_hash", content_hash("node", *every[:4]))


def edge_facts(edges: DataFrame) -> DataFrame:
    """Edges with content_hash; confidences that are not within 0 and 1 fail the job."""
    checked = F.when(F.col("confidence").between(0, 1), F.col("confidence")).otherwise(F.raise_error(F.concat(F.lit("confidence out of range: "), "src")).cast("decimal(9,8)"))
    e = edges.withColumn("confidence", checked)
    return e.withColumn("content_hash", content_hash("edge", F.col("src"), F.col("dst"), F.col("type"), F.col("confidence").cast("decimal(9,4)")))


def bucket_fingerprint(facts: DataFrame, buckets: int = 256) -> DataFrame:
    """A tree hash: one hash over the sorted hashes of each bucket, then one over the buckets. Only buckets are gathered."""
    leaf = facts.withColumn("bucket", F.substring("content_hash", 1, 2)).groupBy("bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("content_hash")), ""), 256).alias("h"))
    return leaf.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda x: x["h"]), ""), 256).alias("fingerprint"))


def exact_fingerprint(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One sha256 over all facts in canonical order; for graphs that fit one row."""
    lines = nodes.select(F.struct(F.lit(0).alias("e"), "type", "id", F.lit("").alias("x"), F.col("content_hash").alias("h")).alias("s")).unionByName(edges.select(F.struct(F.lit(1).alias("e"), F.col("src").alias("type"), F.col("type").alias("id"), F.col("dst").alias("x"), F.col("content_hash").alias("h")).alias("s")))
    return lines.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["h"]), "\n"), 256).alias("fingerprint"))


def type_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    from latticework.operators.merge import overview

    return overview(nodes, edges)


def manifest(files: DataFrame, path: str, text: str) -> DataFrame:
    """(path, hash) of source files."""
    return files.select(F.col(path).alias("path"), F.sha2(F.col(text), 256).alias("hash"))


def source_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, status): added, removed, changed or unchanged between manifests."""
    b, a = before.select("path", F.col("hash").alias("old")), after.select("path", F.col("hash").alias("new"))
    return b.join(a, "path", "full_outer").select("path", file_status(F.col("old"), F.col("new")).alias("status"))


def file_status(old: Column, new: Column) -> Column:
    return F.when(old.isNull() & new.isNull(), "not_recorded").when(old.isNull(), "added").when(new.isNull(), "removed").when(old == new, "unchanged").otherwise("changed")


def staleness(recorded: DataFrame, current: DataFrame, samples: int = 20) -> DataFrame:
    """(status, n, paths): how many files differ from the manifest, with the first paths."""
    rows = source_changes(recorded, current).where("status <> 'unchanged'")
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("path")), 1, samples).alias("paths"))


def new_objects(facts: DataFrame, stored: DataFrame) -> DataFrame:
    """Facts whose content is not stored yet."""
    return facts.dropDuplicates(["content_hash"]).join(stored.select("content_hash"), "content_hash", "left_anti")


def orphans(stored: DataFrame, memberships: DataFrame, keep: int) -> DataFrame:
    """Stored objects that no kept generation has; the newest keep (2 to 50) generations are kept."""
    newest = memberships.select("generation").distinct().orderBy(F.desc("generation")).limit(max(2, min(keep, 50)))
    return stored.join(memberships.join(F.broadcast(newest), "generation").select("content_hash"), "content_hash", "left_anti")


def page(generations: DataFrame, limit: int = 20, before: int | None = None) -> DataFrame:
    """Generations newest first below a cursor; one row more than the limit shows that there are more."""
    rows = generations.where(F.col("generation") < before) if before is not None else generations
    return rows.orderBy(F.desc("generation")).limit(limit + 1)


def broken(facts: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Facts whose stored hash is not that of their payload."""
    return facts.select("id", F.col("content_hash").alias("stored")).join(recomputed.select("id", "content_hash"), "id").where("stored <> content_hash")


class Store:
    """Immutable generations as Parquet below a root that all executors share; a manifest names the current one.

    A generation is written whole before the manifest points at it, so readers see all of it or none.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self.root, *parts))

    def generations(self) -> list[dict]:
        fs = self._fs()
        if not fs.exists(self._path("manifest.json")):
            return []
        return json.loads(self.spark.read.text(os.path.join(self.root, "manifest.json"), wholetext=True).first()[0])

    def current(self) -> dict | None:
        return next(iter(sorted(self.generations(), key=lambda g: -g["id"])), None)

    def publish(self, nodes: DataFrame, edges: DataFrame, retain: int = 10) -> dict:
        """Writes a generation, or returns the current one if its facts are the same; prunes old ones."""
        every = self.generations()
        number = max([0, *(g["id"] for g in every)]) + 1
        base = os.path.join(self.root, f"generation={number}")
        node_facts(nodes).write.mode("overwrite").parquet(f"{base}/nodes")
        edge_facts(edges).write.mode("overwrite").parquet(f"{base}/edges")
        n, e = self.spark.read.parquet(f"{base}/nodes"), self.spark.read.parquet(f"{base}/edges")
        fingerprint = bucket_fingerprint(n.select("content_hash").unionByName(e.select("content_hash"))).first()[0]
        now = self.current()
        if now and now["fingerprint"] == fingerprint:
            self._fs().delete(self._path(f"generation={number}"), True)
            return now
        made = {"id": number, "parent": now["id"] if now else None, "fingerprint": fingerprint, "nodes": n.count(), "edges": e.count(), "created": datetime.now(timezone.utc).isoformat()}
        kept = sorted([*every, made], key=lambda g: -g["id"])[: max(2, min(retain, 50))]
        self._swap(kept)
        for g in every:
            if g["id"] not in {k["id"] for k in kept}:
                self._fs().delete(self._path(f"generation={g['id']}"), True)
        return made

    def _swap(self, generations: list[dict]) -> None:
        fs = self._fs()
        out = fs.create(self._path("manifest.next"), True)
        out.write(bytearray(json.dumps(generations).encode()))
        out.close()
        fs.delete(self._path("manifest.json"), False)
        fs.rename(self._path("manifest.next"), self._path("manifest.json"))

    def load(self, generation: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges of a generation; fails if a stored hash is not that of its payload."""
        g = generation if generation is not None else self.current()["id"]
        n, e = (self.spark.read.parquet(os.path.join(self.root, f"generation={g}", t)) for t in ("nodes", "edges"))
        bad = node_facts(n.drop("content_hash", "semantic_hash").withColumn("was", F.lit(0))).select("id", F.col("content_hash").alias("now")).join(n.select("id", "content_hash"), "id").where("now <> content_hash")
        if not bad.isEmpty():
            raise ValueError(f"generation {g}: stored facts were changed")
        return n, e
