"""Helpers that the operators of this subpackage share: reading tables, durable intermediate tables, Arrow batches."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from latticework.runtime import ship

#: Texts handed to one vectorised step at most, in bytes (a longer text is a step of its own).
STEP_BYTES = 1 << 20
#: Steps after which freed memory is given back.
TRIM = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of this machine where all run on it (tests).

    On a cluster without the setting there is none, and this raises: a folder of each machine would lose rows.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    return f"{tempfile.gettempdir()}/latticework-checkpoints"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete tables that written() made and nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library
        return None


def trim() -> None:
    """Give memory that was freed back to the system: workers live on, and their peaks would add up."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def steps(batches: Iterator[pa.RecordBatch], limit: int = STEP_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, UTF-8 texts) of bounded size from Arrow batches of (id, text); a null text is empty."""
    ids: list = []
    texts: list[bytes] = []
    size = done = 0
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            for key, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                text = text or b""
                if ids and size + len(text) > limit:
                    yield ids, texts
                    ids, texts, size, done = [], [], 0, done + 1
                    if done % TRIM == 0:
                        trim()
                ids.append(key)
                texts.append(text)
                size += len(text) + 16
    if ids:
        yield ids, texts
    del ids, texts
    trim()


def record_batch(columns: dict, types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) for c, t in types.items()], names=list(types))


def filtered(docs: DataFrame, text_col: str, verdicts) -> DataFrame:
    """The rows of docs, all columns as they are, for which verdicts(UTF-8 texts of a step) is true; no shuffle.

    verdicts is made in each task, by calling it once without texts.
    """
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = verdicts()
        for batch in batches:
            numbered = iter([pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column(place)], names=["key", "text"])])
            mask = [bool(x) for _, texts in steps(numbered) for x in keep(texts)]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


__all__ = ["STEP_BYTES", "discard", "filtered", "record_batch", "shared_dir", "ship", "steps", "table", "trim", "written"]
