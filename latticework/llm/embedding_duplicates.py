"""Exact range join of embeddings by cosine, as a metric join of unit vectors.

cosine >= c is a distance of at most eps = sqrt(2 - 2c). Of each label of more than a block, some vectors are pivots, as many as
it has blocks or as the root of its size (fewer, in proportion, where those of all labels would be over PIVOTS; without any, a
label is one cell, and the result is the same); a vector's home is the cell of its nearest pivot, and by the triangle
inequality every partner of the cell's vectors lies within eps of the cell's radius and no more than 2 eps farther from its
pivot than from its own; such vectors visit the cell. Cells, in blocks of home vectors, then join independently: a task holds
one block and streams the cell's vectors past it. Links of a vector are counted at its home alone, and a task returns a
spanning forest of its links for the components.

Equal vectors of a label are one class that stands for all its copies, so a vector with many copies is compared once.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and those with a null label,
link with nothing; vectors of different lengths are not compared; a row without an id has no component and is not linked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.llm.common import written
from latticework.llm.components import UnionFind, components

COSINE = 0.93
#: Home vectors of a block, streamed vectors of a task, and pivots sent, over all labels.
BLOCK, STREAM, PIVOTS = 4096, 1 << 17, 4096
#: Rows of a record batch of copies, and streamed vectors compared at once.
BATCH, COMPARED = 4096, 1024
_SLACK = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    x = x / top
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Cells:
    """The pivots of the labels that have several."""

    def __init__(self, pivots: dict[tuple[int, int], np.ndarray]) -> None:
        self.pivots = pivots

    def distances(self, key: tuple[int, int], x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ self.pivots[key].T)))


def _by_label(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """(label, dimension) and places of its rows."""
    label, dim = batch.column("label").to_numpy(), batch.column("dim").to_numpy()
    keys = np.stack([label, dim], 1)
    for key in np.unique(keys, axis=0):
        yield (int(key[0]), int(key[1])), np.flatnonzero((keys == key).all(1))


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id and kept."""
    spark = vectors.sparkSession
    eps = math.sqrt(max(0.0, 2 - 2 * cosine))
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"), vectors[label_col].cast("long").alias("label"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(finite, F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    # -0.0 is 0.0 as a component, so equal vectors are equal keys
    keyed = written(rows.select("vec_id", F.when(usable, F.transform("v", lambda x: x + 0.0)).alias("v"), F.when(usable, F.col("label")).alias("label")), "vectors")
    good = keyed.where("label IS NOT NULL")
    classes = good.groupBy("label", "v").agg(F.min("vec_id").alias("class"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("dim", F.size("v").cast("long")), "vector_classes")
    counts = classes.groupBy("label", "dim").agg(F.count("*").alias("total"))
    with_total = classes.join(counts, ["label", "dim"])
    # as many pivots as blocks or as the root of a label's size, all scaled down alike where they would be more than PIVOTS
    large = counts.where(F.col("total") > BLOCK)
    ideal = F.least(F.ceil(F.col("total") / BLOCK), F.ceil(F.sqrt("total")))
    whole = large.agg(F.sum(ideal)).first()[0] or 0
    wanted = F.floor(ideal * min(1.0, PIVOTS / max(whole, 1)))
    drawn = classes.join(large.withColumn("wanted", wanted).where("wanted > 1"), ["label", "dim"]).withColumn("h", F.xxhash64("class"))
    # twice as many candidates as are wanted, on average, so that the first by hash are enough
    near = drawn.where(F.pmod("h", F.lit(1 << 30)) < F.lit(float(1 << 31)) * F.col("wanted") / F.col("total"))
    ranked = near.withColumn("k", F.row_number().over(Window.partitionBy("label", "dim").orderBy("h", "class"))).where("k <= wanted")
    pivots: dict[tuple[int, int], list] = {}
    for r in ranked.select("label", "dim", "k", "v").orderBy("label", "dim", "k").collect():
        pivots.setdefault((r["label"], r["dim"]), []).append(r["v"])
    cells = spark.sparkContext.broadcast(Cells({k: unit(np.array(v)) for k, v in pivots.items()}))

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, at in _by_label(batch):
                if key in cells.value.pivots:
                    d = cells.value.distances(key, unit(_matrix(batch.column("v").take(pa.array(at)))))
                    home = d.argmin(1)
                    m = len(at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, key[0])), pa.array(np.full(m, key[1])), pa.array(home), pa.array(d[np.arange(m), home])], names=["label", "dim", "cell", "d"])

    extent = {(r["label"], r["dim"], r["cell"]): (r["r"], r["n"]) for r in classes.mapInArrow(homes, "label long, dim long, cell long, d double").groupBy("label", "dim", "cell").agg(F.max("d").alias("r"), F.count("*").alias("n")).collect()} if pivots else {}
    extents = spark.sparkContext.broadcast(extent)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (label, dim, cell, block, part, role): role 0 is held at home, role 1 streams past."""
        for batch in batches:
            held, size = [], 0
            for copies in places(batch):
                held.append(copies)
                size += len(copies[0])
                if size >= BATCH:
                    yield from copied(batch, held)
                    held, size = [], 0
            if held:
                yield from copied(batch, held)

    def places(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        """(places, cells, blocks, parts, roles) of the copies of a batch's rows, one block at a time."""
        ids, total = batch.column("class").to_numpy(), batch.column("total").to_numpy()
        salt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        for key, at in _by_label(batch):
            parts = int(-(-total[at[0]] // STREAM))
            if key in cells.value.pivots:
                d = cells.value.distances(key, unit(_matrix(batch.column("v").take(pa.array(at)))))
                home = d.argmin(1)
                near = d[np.arange(len(at)), home]
                in_cell = [(c, *extents.value.get((*key, c), (-1.0, 0))) for c in range(d.shape[1])]
            else:
                d = near = home = np.zeros(len(at), int)
                in_cell = [(0, math.inf, int(total[at[0]]))]
            for c, radius, n in in_cell:
                if not n:
                    continue
                blocks = -(-n // BLOCK)
                mine = at[home == c]
                comes = at[(d[:, c] <= near + 2 * eps + _SLACK) & (d[:, c] <= radius + eps + _SLACK)] if key in cells.value.pivots else at
                own, guest = (salt[mine] % np.uint64(blocks)).astype(np.int64), (salt[comes] // np.uint64(7919) % np.uint64(parts)).astype(np.int64)
                for p in range(parts if len(mine) else 0):
                    yield mine, np.full(len(mine), c), own, np.full(len(mine), p), np.zeros(len(mine), np.int64)
                for k in range(blocks if len(comes) else 0):
                    yield comes, np.full(len(comes), c), np.full(len(comes), k), guest, np.ones(len(comes), np.int64)

    def copied(batch: pa.RecordBatch, held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        at, *extra = (np.concatenate(x) for x in zip(*held, strict=True))
        for i in range(0, len(at), BATCH):
            j = slice(i, i + BATCH)
            rows = pa.array(at[j])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("label", "dim")), *(pa.array(x[j]) for x in extra), *(batch.column(c).take(rows) for c in ("class", "copies", "v"))], names=["label", "dim", "cell", "block", "part", "role", "class", "copies", "v"])

    dealt = with_total.mapInArrow(deal, "label long, dim long, cell long, block long, part long, role long, class long, copies long, v array<double>")
    dealt = dealt.repartition("label", "dim", "cell", "block", "part").sortWithinPartitions("label", "dim", "cell", "block", "part", "role", "class")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (a, b, links): a link for the components, or (home, null, number of links)."""
        held_key, ids, x, links, root = None, np.zeros(0, np.int64), None, None, np.zeros(0, np.int64)

        def done() -> Iterator[pa.RecordBatch]:
            if len(ids):
                tied = np.flatnonzero(root != np.arange(len(ids)))
                yield _links(np.append(ids[tied], ids), np.append(ids[root[tied]], np.full(len(ids), -1)), np.append(np.full(len(tied), -1), links), len(tied))

        for part in _runs(batches, 6):
            key = tuple(part.column(c)[0].as_py() for c in range(5))
            if key != held_key:
                yield from done()
                held_key, ids, x, links, root = key, np.zeros(0, np.int64), None, np.zeros(0, np.int64), np.zeros(0, np.int64)
            mine, y = part.column("class").to_numpy(), unit(_matrix(part.column("v")))
            if part.column("role")[0].as_py() == 0:
                ids, x = np.append(ids, mine), y if x is None else np.concatenate([x, y])
                links, root = np.append(links, np.zeros(len(mine), np.int64)), np.arange(len(ids))
            elif x is not None:
                near = (x @ y.T >= cosine) & (ids[:, None] != mine[None])
                links += near @ part.column("copies").to_numpy()
                guests = np.flatnonzero(near.any(0))
                first = near[:, guests].argmax(0)
                yield _links(ids[first], mine[guests], np.full(len(guests), -1), len(guests))
                for g in guests.tolist():  # homes that a guest is linked with are one component
                    roots = root[near[:, g]]
                    if (roots != roots[0]).any():
                        root[np.isin(root, roots)] = roots.min()
        yield from done()

    joined = written(dealt.mapInArrow(join, "a long, b long, links long"), "vector_links")
    found = written(components(joined.where("b IS NOT NULL").select("a", "b")), "vector_components")
    linked = joined.where("links IS NOT NULL").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    of_class = classes.select("label", "v", "class", "copies").join(linked, "class", "left").join(found.select(F.col("node").alias("class"), "component"), "class", "left")
    per_vector = of_class.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "class").alias("component"))
    out = keyed.join(per_vector, ["label", "v"], "left")
    result = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return result.withColumn("kept", F.col("component_id").eqNullSafe(F.col("vec_id")))


def _runs(batches: Iterator[pa.RecordBatch], keys: int, rows: int = COMPARED) -> Iterator[pa.RecordBatch]:
    """Slices of bounded length in which the leading columns are equal."""
    for b in batches:
        change = np.zeros(b.num_rows, bool)
        for c in range(keys):
            x = b.column(c).to_numpy()
            change[1:] |= x[1:] != x[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for a, e in zip(cuts[:-1], cuts[1:], strict=True):
            for start in range(a, e, rows):
                yield b.slice(start, min(rows, e - start))


def _links(a: np.ndarray, b: np.ndarray, links: np.ndarray, n_edges: int) -> pa.RecordBatch:
    edge = np.arange(len(a)) < n_edges
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64(), mask=~edge), pa.array(links, pa.int64(), mask=edge)], names=["a", "b", "links"])


def brute_force(rows: list[tuple[int, list | None, int | None]], cosine: float = COSINE) -> dict[int, tuple[int, int]]:
    """(n_links, component) of each id, by comparing all pairs."""
    rows = sorted(rows, key=lambda r: r[0])
    vectors = []
    for _, v, label in rows:
        ok = v is not None and label is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        vectors.append(np.array(v, float) if ok else None)
    n, uf = [0] * len(rows), UnionFind(len(rows))
    for i, a in enumerate(vectors):
        for j in range(i):
            b = vectors[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= cosine:
                n[i] += 1
                n[j] += 1
                uf.join(i, j)
    return {r[0]: (n[i], rows[uf.find(i)][0]) for i, r in enumerate(rows)}
