"""Verification of a change: two generations, the files and targets it names, and what the graph shows of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.operators import diff, index, store, traverse


def source_coverage(before: DataFrame, after: DataFrame, requested: DataFrame) -> DataFrame:
    """(path, status) of the requested files (path) between two manifests; a file in neither is not recorded."""
    b, a = before.select("path", F.col("hash").alias("old")), after.select("path", F.col("hash").alias("new"))
    return requested.select("path").distinct().join(b, "path", "left").join(a, "path", "left").select("path", store.file_status(F.col("old"), F.col("new")).alias("status"))


def nodes_for_files(nodes: DataFrame, files: DataFrame, limit: int = 10_000) -> DataFrame:
    return nodes.join(files.select(F.col("path").alias("file")), "file", "left_semi").select("id").orderBy("id").limit(limit)


def shared_resources(nodes: DataFrame) -> DataFrame:
    return nodes.where("type IN ('table', 'column', 'model')").select("id")


def target_scope(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], targets: list[str], depth: int = 2, least: float = 0.0) -> tuple[DataFrame, DataFrame, bool]:
    """(scope ids, seed ids, exact): the neighbourhoods of the targets in both generations; exact if all are resolved."""
    spark, found, exact = before[0].sparkSession, [], True
    for t in targets:
        hits = [r["id"] for g in (before, after) for r in index.resolve_historical(g[0], t).where("resolved").collect()]  # at most one a generation
        exact &= bool(hits)
        found += hits
    seeds = spark.createDataFrame([(i,) for i in sorted(set(found))], "id string")
    around = [traverse.neighbourhood(seeds, g[1], depth, least).select(F.col("node").alias("id")) for g in (before, after)]
    return around[0].unionByName(around[1]).distinct(), seeds, exact


def status(same: bool, changes: int, scoped: bool, in_scope: int, collateral: int | None, uncertain: bool) -> str:
    """What a verification says, in one word (fixed values)."""
    if same:
        out = "same_generation_selected"
    elif changes == 0:
        out = "no_graph_delta_observed"
    elif not scoped:
        out = "graph_changes_observed"
    elif in_scope > 0 and collateral:
        out = "expected_and_collateral_graph_changes_observed"
    elif in_scope > 0:
        out = "expected_graph_changes_observed"
    elif collateral:
        out = "collateral_graph_changes_observed"
    else:
        out = "graph_changes_observed"
    return out + ("_with_uncertainties" if uncertain else "")


def verify(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], targets: list[str] = (), files: list[str] = (), depth: int = 2, limit: int = 50) -> dict:
    """Counts, findings and status of the changes between two generations (nodes and edges with hashes)."""
    changes = diff.changes(before, after).persist()
    try:
        total = changes.count()
        scoped, in_scope, collateral, exact = bool(targets or files), 0, None, True
        if scoped:
            scope, seeds, exact = target_scope(before, after, list(targets), depth)
            if files:
                spark = before[0].sparkSession
                named = spark.createDataFrame([(f,) for f in files], "path string")
                of_files = nodes_for_files(before[0], named).unionByName(nodes_for_files(after[0], named)).distinct()
                exact &= not of_files.isEmpty()
                scope, seeds = scope.unionByName(of_files).distinct(), seeds.unionByName(of_files).distinct()
            shared = shared_resources(before[0]).unionByName(shared_resources(after[0])).distinct()
            in_scope = diff.in_scope(changes, scope, seeds, shared).count()
            collateral = total - in_scope if exact else None
        counts = {"|".join(str(r[c]) for c in ("category", "entity", "kind")): r["n"] for r in changes.groupBy("category", "entity", "kind").agg(F.count("*").alias("n")).collect()}
        found = [r.asDict() for r in diff.ordered_findings(diff.findings(changes), limit).collect()]
        return {"status": status(False, total, scoped, in_scope, collateral, not exact), "changes": total, "inScope": in_scope, "collateral": collateral, "counts": counts, "findings": found}
    finally:
        changes.unpersist()


def receipt(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], details: int = 25) -> dict:
    """What a rebuild changed: counts, and some details of each category that has any."""
    changes = diff.changes(before, after)
    groups: dict[str, list] = {}
    for r in diff.fair_details(changes, details).orderBy("category", "rank").collect():
        groups.setdefault(r["category"], []).append({"kind": r["kind"], "identity": r["identity"]})
    return {"changes": changes.count(), "details": groups}
