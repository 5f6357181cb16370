"""Differences of generations, findings, and the changes in a scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework import schema


def category(entity: Column, before: Column, after: Column) -> Column:
    """The first category whose types hold the type before or after; else the kind of fact."""
    out = F.when(entity == "node", "nodes").otherwise("edges")
    for name, node_types, edge_types in reversed(schema.CATEGORIES):
        is_in = lambda c, types: F.coalesce(c.isin(*types), F.lit(False)) if types else F.lit(False)
        node = (entity == "node") & (is_in(before, node_types) | is_in(after, node_types))
        edge = (entity == "edge") & (is_in(before, edge_types) | is_in(after, edge_types))
        out = F.when(node | edge, F.lit(name)).otherwise(out)
    return out


def changes(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(entity, identity, kind, category, type, semantic, src, dst): facts added, removed or changed.

    Nodes have id, type, content_hash, semantic_hash; edges src, dst, type, content_hash. One full outer join each.
    """

    def one(entity: str, keys: list[str], b: DataFrame, a: DataFrame, hashes: list[str]) -> DataFrame:
        b2 = b.select(*keys, F.col("type").alias("bt") if "type" not in keys else F.col("type").alias("bt"), *(F.col(h).alias(f"b_{h}") for h in hashes))
        a2 = a.select(*keys, F.col("type").alias("at"), *(F.col(h).alias(f"a_{h}") for h in hashes))
        j = b2.join(a2, keys, "full_outer").where(f"NOT (b_{hashes[0]} <=> a_{hashes[0]})")
        kind = F.when(F.col(f"b_{hashes[0]}").isNull(), "added").when(F.col(f"a_{hashes[0]}").isNull(), "removed").otherwise("changed")
        semantic = ~F.col(f"b_{hashes[-1]}").eqNullSafe(F.col(f"a_{hashes[-1]}"))
        identity = F.concat_ws("|", *keys)
        ends = [F.col("src"), F.col("dst")] if "src" in keys else [F.col("id").alias("src"), F.lit(None).cast("string").alias("dst")]
        return j.select(F.lit(entity).alias("entity"), identity.alias("identity"), kind.alias("kind"), category(F.lit(entity), F.col("bt"), F.col("at")).alias("category"), F.coalesce("at", "bt").alias("type"), semantic.alias("semantic"), *ends)

    nodes = one("node", ["id"], before[0], after[0], ["content_hash", "semantic_hash"])
    edges = one("edge", ["src", "dst", "type"], before[1], after[1], ["content_hash"])
    return nodes.unionByName(edges)


def counts(diff: DataFrame) -> DataFrame:
    """(category, entity, kind, n), with totals where a column is null."""
    return diff.rollup("category", "entity", "kind").agg(F.count("*").alias("n"))


KIND_ORDER = {"removed": 0, "changed": 1, "added": 2}


def _kind(kind: Column) -> Column:
    return F.when(kind == "removed", 0).when(kind == "changed", 1).otherwise(2)


def details(diff: DataFrame, limit: int) -> DataFrame:
    """The first changes of each category by (entity, identity, kind)."""
    order = Window.partitionBy("category").orderBy("entity", "identity", _kind(F.col("kind")))
    return diff.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def fair_details(diff: DataFrame, budget: int) -> DataFrame:
    """Details under one budget: each category in turn may take an equal share of what is left, rounded up."""
    totals = {r["category"]: r["n"] for r in diff.groupBy("category").agg(F.count("*").alias("n")).collect()}  # eight categories
    left, shares = budget, {}
    names = [c for c in [*(n for n, _, _ in schema.CATEGORIES), "nodes", "edges"] if c in totals]
    for i, c in enumerate(names):
        shares[c] = min(totals[c], -(-left // (len(names) - i)))
        left -= shares[c]
    share = F.lit(0)
    for c, n in shares.items():
        share = F.when(F.col("category") == c, n).otherwise(share)
    return details(diff, budget).where(F.col("rank") <= share)


#: Findings: (category, types, kind) → (code, severity), the first that holds (fixed values); no types: all.
RULES = (
    ("routes", ("route",), "removed", "route_removed", "high"),
    ("routes", ("routes_to",), "removed", "route_action_removed", "high"),
    ("routes", ("routes_to",), "added", "route_action_added", "medium"),
    ("routes", ("passes_through",), "removed", "route_middleware_edge_removed", "high"),
    ("routes", ("passes_through",), "added", "route_middleware_edge_added", "medium"),
    ("routes", (), "changed", "route_semantics_changed", "medium"),
    ("writes", (), "added", "write_surface_added", "high"),
    ("writes", (), "changed", "write_semantics_changed", "high"),
    ("writes", (), "removed", "write_surface_removed", "medium"),
    ("authorization", ("authorizes_via",), "removed", "authorization_edge_removed", "high"),
    ("authorization", ("authorizes_via",), "changed", "authorization_semantics_changed", "high"),
    ("authorization", ("policy",), "removed", "policy_node_removed", "high"),
    ("authorization", (), "added", "authorization_fact_added", "info"),
    ("queues", ("handled_by", "listens_to", "observes"), "removed", "active_handler_edge_removed", "high"),
    ("queues", ("event", "job"), "removed", "queue_or_event_node_removed", "high"),
    ("queues", ("dispatches",), "changed", "dispatch_semantics_changed", "high"),
    ("queues", ("dispatches",), "removed", "dispatch_edge_removed", "medium"),
    ("queues", (), "added", "queue_fact_added", "medium"),
    ("tests", ("tests_route",), "removed", "test_route_mapping_removed", "high"),
    ("tests", ("runtime_covers",), "removed", "runtime_coverage_mapping_removed", "medium"),
    ("tests", ("test",), "removed", "test_node_removed", "medium"),
)
SEVERITY = {"high": 0, "medium": 1, "low": 2, "info": 3}


def findings(diff: DataFrame) -> DataFrame:
    """(code, severity, identity) of the changes that a rule names; a change counts only if it is semantic (unknown: it is)."""
    code, severity = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c, types, kind, name, level in reversed(RULES):
        hit = (F.col("category") == c) & (F.col("kind") == kind)
        hit = hit & F.col("type").isin(*types) if types else hit
        code, severity = F.when(hit, name).otherwise(code), F.when(hit, level).otherwise(severity)
    rows = diff.where((F.col("kind") != "changed") | F.coalesce("semantic", F.lit(True)))
    return rows.select(code.alias("code"), severity.alias("severity"), "identity").where("code IS NOT NULL")


def ordered_findings(found: DataFrame, limit: int) -> DataFrame:
    rank = F.lit(9)
    for s, i in SEVERITY.items():
        rank = F.when(F.col("severity") == s, i).otherwise(rank)
    return found.orderBy(rank, "code", "identity").limit(limit)


def in_scope(diff: DataFrame, scope: DataFrame, seeds: DataFrame, shared: DataFrame) -> DataFrame:
    """Changes of nodes in the scope (id), and of edges with both ends in it, or one that is a seed or no shared resource."""
    inside = lambda c, name: scope.select(F.col("id").alias(c), F.lit(True).alias(name)).distinct()
    explicit = seeds.select(F.col("id").alias("x")).distinct()
    common = shared.select(F.col("id").alias("x")).distinct().join(explicit, "x", "left_anti")
    rows = diff.join(inside("src", "s"), "src", "left").join(inside("dst", "d"), "dst", "left")
    weak = lambda c, name: common.select(F.col("x").alias(c), F.lit(True).alias(name))
    rows = rows.join(weak("src", "ws"), "src", "left").join(weak("dst", "wd"), "dst", "left")
    s, d, ws, wd = (F.coalesce(c, F.lit(False)) for c in ("s", "d", "ws", "wd"))
    hit = F.when(F.col("entity") == "node", s).otherwise((s & d) | (s & ~ws) | (d & ~wd))
    return rows.where(hit).select(*diff.columns)


def multiset_difference(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, added, removed): by how much each value's number grew or fell."""
    b, a = before.groupBy(key).agg(F.count("*").alias("b")), after.groupBy(key).agg(F.count("*").alias("a"))
    delta = F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))
    return b.join(a, key, "full_outer").select(key, F.greatest(delta, F.lit(0)).cast("long").alias("added"), F.greatest(-delta, F.lit(0)).cast("long").alias("removed")).where("added > 0 OR removed > 0")
