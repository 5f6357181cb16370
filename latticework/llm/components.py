"""Connected components of a graph of any size, and union-find for the bounded graphs of one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from latticework.llm.common import discard, written


class UnionFind:
    """Components of 0..n-1; the smallest member stands for each."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def spanning(similar: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the graph with this adjacency matrix, by breadth-first search over its rows."""
    n = len(similar)
    free, out = np.ones(n, bool), []
    for seed in range(n):
        if not free[seed]:
            continue
        free[seed] = False
        queue = [seed]
        while queue and free.any():
            x = queue.pop()
            new = np.flatnonzero(similar[x] & free)
            free[new] = False
            queue += new.tolist()
            out += [(x, int(y)) for y in new]
    return out


#: Nodes that count as hubs at most, over all: a hub has more edges than this share of them, so that their table is small.
HUBS, LEAST_HUB = 20_000, 256


def _least(rows: DataFrame, n_edges: int) -> tuple[DataFrame, DataFrame]:
    """(u, m) the least v of each u: of hubs, which have many rows, and of all others."""
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    most = max(LEAST_HUB, 2 * n_edges // HUBS)
    return least.where(F.col("n") > most).select("u", "m"), least.where(F.col("n") <= most).select("u", "m")


def _with_least(rows: DataFrame, hubs: DataFrame, others: DataFrame) -> DataFrame:
    """(u, v, m): every row meets its least. Rows of hubs do so where they are (2 * n_edges / most hubs at most), others by a shuffle."""
    marked = rows.join(F.broadcast(hubs.withColumnRenamed("m", "hub")), "u", "left")
    of_hubs = marked.where("hub IS NOT NULL").select("u", "v", F.col("hub").alias("m"))
    return of_hubs.unionByName(marked.where("hub IS NULL").select("u", "v").join(others, "u").select("u", "v", "m"))


def _edges(rows: DataFrame) -> tuple[DataFrame, tuple]:
    """Edges (u, v), each once, written, and what tells whether they changed, observed on the way."""
    h, seen = F.xxhash64("u", "v"), Observation()
    out = written(rows.where("u <> v").distinct().observe(seen, F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h % 1_000_003).alias("s")), "edges")
    return out, (seen.get["n"], seen.get["x"], seen.get["s"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of edges (a, b), the smallest node that it is connected with.

    Large-star and small-star rounds: each hangs the larger neighbours of every node, then its smaller ones, onto the smallest,
    until nothing changes. A round is two joins on nodes with pre-aggregated minima, in which a hub's edges stay where they are;
    its edges go to the shared folder. The number of rounds grows with the logarithm of the nodes, and has no other limit.
    """
    e, state = _edges(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both.where("v > u"), *_least(both, state[0])).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = written(large, "edges")
        small = _with_least(large, *_least(large, state[0])).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        new, seen = _edges(small.select("x.u", "x.v"))
        discard(e, large)
        e = new
        if seen == state:
            break
        state = seen
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
