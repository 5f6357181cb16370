"""Observations as a stream, upserted into a Parquet snapshot."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.operators.observe import latest


class Snapshot:
    """The last capture of each (file, test), as Parquet versions below a shared root; one writer.

    A batch recomputes its keys from the snapshot and its own rows, so a batch that runs again changes nothing.
    """

    KEYS = ["file", "test"]

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.version = spark, root, None

    def read(self) -> DataFrame | None:
        return self.spark.read.parquet(self.version) if self.version else None

    def upsert(self, batch: DataFrame, _: int = 0) -> None:
        old = self.read()
        rows = batch.select(*self.KEYS, "captured_at", "session", "lines")
        merged = latest(rows if old is None else old.unionByName(rows), self.KEYS, "captured_at", "session", "lines")
        path = f"{self.root}/snapshot-{uuid.uuid4().hex}"
        merged.write.parquet(path)
        self.version = path

    def follow(self, stream: DataFrame, checkpoint: str):
        """Starts the upserts of a stream of observations."""
        return stream.writeStream.foreachBatch(self.upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n): sessions of events, streaming or not; an addition of this engine."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("at", late) if events.isStreaming else rows
    return rows.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
