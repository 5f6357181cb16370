"""Named queries over a graph, with bounded answers."""

from __future__ import annotations

import fcntl
import os
import time
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions import limits
from latticework.operators import diff, engine, index, store, traverse, verify
from latticework.plans import planner

#: Depths that public queries allow.
MAX_DEPTH = 6


class Engine:
    """Queries by name over one graph, or one generation of a store."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, revision: int | None = None, previous: tuple[DataFrame, DataFrame] | None = None) -> None:
        self.nodes, self.edges, self.revision, self.previous = nodes, edges, revision, previous

    @classmethod
    def of_store(cls, s: store.Store, generation: int | None = None) -> Engine:
        now = generation if generation is not None else s.current()["id"]
        older = [g["id"] for g in s.generations() if g["id"] < now]
        return cls(*s.load(now), now, s.load(max(older)) if older else None)

    def _seed(self, target: str) -> DataFrame:
        rows = index.resolve(self.nodes, target).collect()
        if len(rows) != 1 or not rows[0]["resolved"]:
            raise LookupError({"target": target, "candidates": [r["id"] for r in rows]})
        return self.nodes.where(F.col("id") == rows[0]["id"]).select("id", F.lit("1").cast("decimal(5,4)").alias("confidence"))

    def query(self, name: str, target: str | None = None, depth: int = 4, limit: int = 50, min_confidence: float = 0.0) -> dict:
        """The answer to one of the named queries, within the ceiling of a response."""
        if name not in QUERIES:
            raise ValueError(f"unknown query {name}; there are {', '.join(QUERIES)}")
        if not 0 <= depth <= MAX_DEPTH:
            raise ValueError(f"depth must be within 0 and {MAX_DEPTH}")
        answer = QUERIES[name](self, target, depth, limit, min_confidence)
        rows = answer if isinstance(answer, dict) else {"results": [_plain(r) for r in answer.collect()]}
        return limits.limit(limits.envelope(name, target, rows, self.revision, datetime.now(timezone.utc).isoformat(), any(r.get("truncated") for r in rows.get("results", []))))


def _plain(row) -> dict:
    from decimal import Decimal

    return {k: float(v) if isinstance(v, Decimal) else v for k, v in row.asDict(recursive=True).items() if v is not None}


def _table(e: Engine, target: str) -> str:
    """The table of a model, or the owner of a column, else the target itself."""
    found = e._seed(target).join(e.nodes, "id").select("id", "type").first()
    if found["type"] == "model":
        row = e.edges.where((F.col("type") == "uses_table") & (F.col("src") == found["id"])).agg(F.min("dst")).first()
        return row[0]
    if found["type"] == "column":
        return e.edges.where((F.col("type") == "has_column") & (F.col("dst") == found["id"])).agg(F.min("src")).first()[0]
    return found["id"]


def _before(e: Engine) -> tuple:
    if e.previous is None:
        raise LookupError("no earlier generation")
    return e.previous, (e.nodes, e.edges)


QUERIES = {
    "overview": lambda e, t, d, n, c: engine_overview(e),
    "find": lambda e, t, d, n, c: engine.find(e.nodes, e.edges, t, n),
    "search": lambda e, t, d, n, c: index.located(index.search(e.nodes, t, None, n)),
    "node": lambda e, t, d, n, c: engine.card(e.nodes, e.edges, e._seed(t).first()["id"], n),
    "writes-to": lambda e, t, d, n, c: engine.table_access(e.edges, "writes", _table(e, t), n),
    "reads-from": lambda e, t, d, n, c: engine.table_access(e.edges, "reads", _table(e, t), n),
    "callers-of": lambda e, t, d, n, c: traverse.traverse(e._seed(t), e.edges, ("calls",), "in", d, c, n),
    "calls-from": lambda e, t, d, n, c: traverse.traverse(e._seed(t), e.edges, ("calls",), "out", d, c, n),
    "flow-from": lambda e, t, d, n, c: flow(e, t, d, n, c),
    "impact-of": lambda e, t, d, n, c: traverse.impact_top(e._seed(t), e.nodes, e.edges, n, d, c).orderBy("type", "depth", "node"),
    "routes-touching": lambda e, t, d, n, c: traverse.impact_top(e._seed(t), e.nodes, e.edges, n, d, c, "route"),
    "models": lambda e, t, d, n, c: engine.models(e.nodes, e.edges, n),
    "tables": lambda e, t, d, n, c: engine.tables(e.nodes, e.edges, n),
    "context": lambda e, t, d, n, c: planner.expand(planner.lexical_seeds(e.nodes, t), e.nodes, e.edges, min(d, 4), c).orderBy(F.desc("score"), "id").limit(n),
    "diff": lambda e, t, d, n, c: diff.details(diff.changes(*_before(e)), n),
    "verify": lambda e, t, d, n, c: verify.verify(*_before(e), [t] if t else [], depth=min(d, 3), limit=n),
}


def engine_overview(e: Engine) -> dict:
    counts = store.type_counts(e.nodes, e.edges).collect()
    return {kind: {r["type"]: r["n"] for r in counts if r["entity"] == kind} for kind in ("node", "edge")}


def flow(e: Engine, target: str, depth: int, limit: int, least: float) -> dict:
    """Methods and related facts of a route."""
    routes = e._seed(target).select("id")
    methods = engine.flow_methods(e.nodes, e.edges, routes, depth, limit, least)
    related: dict[str, list] = {}
    for r in engine.flow_related(methods, e.edges, limit, least).orderBy("group", F.desc("confidence"), "depth", "target").collect():
        related.setdefault(r["group"], []).append({"target": r["target"], "confidence": float(r["confidence"]), "depth": r["depth"]})
    return {"results": [_plain(r) for r in methods.orderBy(F.desc("confidence"), "depth", "path").collect()], **related}


def route_overview(nodes: DataFrame, edges: DataFrame, depth: int = 4, limit: int = 10) -> DataFrame:
    """(route, group, targets): a bounded summary of every route's flow, all routes at once."""
    methods = engine.flow_methods(nodes, edges, nodes.where("type = 'route'").select("id"), depth)
    related = engine.flow_related(methods, edges, limit)
    return related.groupBy("route", "group").agg(F.array_sort(F.collect_list("target")).alias("targets"))


@contextmanager
def exclusive(path: str, timeout: float = 30.0):
    """One rebuild at a time: a file lock on the driver, polled every 50 ms."""
    with open(path, "a+") as f:
        end = time.monotonic() + timeout
        while True:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                break
            except BlockingIOError:
                if time.monotonic() > end:
                    raise TimeoutError(f"another rebuild holds {path}") from None
                time.sleep(0.05)
        f.seek(0)
        f.truncate()
        f.write(str(os.getpid()))
        f.flush()
        yield


def rebuild(s: store.Store, nodes: DataFrame, edges: DataFrame, lock: str) -> dict:
    """Publishes a generation and says what it changed."""
    with exclusive(lock):
        old = s.current()
        new = s.publish(nodes, edges)
    if not old or old["id"] == new["id"]:
        return {"generation": new["id"], "changes": 0, "details": {}}
    return {"generation": new["id"], **verify.receipt(s.load(old["id"]), s.load(new["id"]))}
