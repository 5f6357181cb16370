"""Ranked, bounded traversals as level-synchronous joins.

The best path to a node by (confidence falling, depth, path) is found without a priority queue: confidences are at most 1, so
a path never outranks its own beginning, and keeping the best state of each (seed, node) at every depth keeps every best
path. One level is one join with the edges and one top-1. The edges that a traversal follows and every level are written to the
shared folder, so a level is computed once however often it is used, plans do not grow with the depth, and a frontier whose
size is known to be small is sent to the edges instead of the edges to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework import schema
from latticework.runtime import written

_STATE = ["seed", "node", "depth", "confidence", "path", "via"]


def product(a: Column, b: Column) -> Column:
    """Confidence of a path with one more edge, rounded to four decimals."""
    return F.round(a.cast(schema.PATH_CONFIDENCE) * b.cast(schema.EDGE_CONFIDENCE), 4).cast(schema.PATH_CONFIDENCE)


def directed(edges: DataFrame, types: tuple[str, ...] | None, direction: str) -> DataFrame:
    """(near, far, kind, weight) of the edges of some types."""
    e = edges.where(F.col("type").isin(*types)) if types else edges
    near, far = ("src", "dst") if direction == "out" else ("dst", "src")
    return e.select(F.col(near).alias("near"), F.col(far).alias("far"), F.col("type").alias("kind"), F.col("confidence").alias("weight"))


def start(seeds: DataFrame) -> DataFrame:
    """States of depth 0 of seeds (id, confidence)."""
    return seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(0).alias("depth"), F.col("confidence").cast(schema.PATH_CONFIDENCE).alias("confidence"), F.array("id").alias("path"), F.lit(None).cast("string").alias("via"))


def transitions(frontier: DataFrame, steps: DataFrame) -> DataFrame:
    """All ways to go on from the states, admissible or not."""
    f = frontier.alias("f")
    return f.join(steps, F.col("node") == F.col("near")).select(
        "seed", F.col("far").alias("node"), (F.col("depth") + 1).alias("depth"), product(F.col("confidence"), F.col("weight")).alias("confidence"),
        F.concat("path", F.array("far")).alias("path"), F.col("kind").alias("via"), F.array_contains("path", F.col("far")).alias("cycle"),
    )


def best_states(rows: DataFrame, keys: tuple[str, ...] = ("seed", "node")) -> DataFrame:
    """The best state of each key at one depth; an aggregate, so that most candidates go before the shuffle."""
    order = F.struct((-F.col("confidence")).alias("c"), "path", F.col("via").alias("v"))
    return rows.groupBy(*keys, "depth").agg(F.min(order).alias("s")).select("seed", "node", "depth", (-F.col("s.c")).cast(schema.PATH_CONFIDENCE).alias("confidence"), F.col("s.path").alias("path"), F.col("s.v").alias("via"))


def levels(seeds: DataFrame, steps: DataFrame, depth: int, least: float = 0.0) -> list[DataFrame]:
    """The frontier of each depth, 0 to depth."""
    out = [written(start(seeds), "frontier")]
    for _ in range(depth):
        rows = transitions(out[-1], steps).where(~F.col("cycle") & (F.col("confidence") >= F.lit(str(least)).cast(schema.PATH_CONFIDENCE)))
        out.append(written(best_states(rows), "frontier"))
    return out


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def best_hits(states: DataFrame) -> DataFrame:
    """The best state of each node over all depths, but for the seed itself."""
    order = F.struct((-F.col("confidence")).alias("c"), "depth", "path", F.col("via").alias("v"))
    best = states.where("depth > 0 AND node <> seed").groupBy("seed", "node").agg(F.min(order).alias("s"))
    return best.select("seed", "node", F.col("s.depth").alias("depth"), (-F.col("s.c")).cast(schema.PATH_CONFIDENCE).alias("confidence"), F.col("s.path").alias("path"), F.col("s.v").alias("via"))


def traverse(seeds: DataFrame, edges: DataFrame, types: tuple[str, ...] | None, direction: str = "out", depth: int = 4, least: float = 0.0, limit: int | None = None, results: DataFrame | None = None) -> DataFrame:
    """seed, node, depth, confidence, path, via, truncated: the best path from each seed to each node.

    results (id): only these nodes are results. truncated: of a seed, that nodes are left out, by the limit, or because a
    state at the last depth has an admissible step left.
    """
    steps = written(directed(edges, types, direction), "steps")
    by_depth = levels(seeds, steps, depth, least)
    hits = best_hits(_union(by_depth[1:])) if depth else by_depth[0].limit(0)
    if results is not None:
        hits = hits.join(results.select(F.col("id").alias("node")), "node", "left_semi")
    beyond = transitions(by_depth[-1], steps).where(~F.col("cycle") & (F.col("confidence") >= F.lit(str(least)).cast(schema.PATH_CONFIDENCE))).select("seed").distinct().withColumn("deeper", F.lit(True))
    out = hits.join(beyond, "seed", "left").withColumn("truncated", F.coalesce("deeper", F.lit(False))).drop("deeper")
    if limit is not None:
        order = Window.partitionBy("seed").orderBy(F.desc("confidence"), "depth", "path", "node")
        out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit + 1)
        out = out.withColumn("truncated", F.col("truncated") | (F.max("rank").over(Window.partitionBy("seed")) > limit)).where(F.col("rank") <= limit)
    return out.select("seed", "node", "depth", "confidence", "path", "via", "truncated")


def budgeted(seeds: DataFrame, edges: DataFrame, types: tuple[str, ...], budget: int, direction: str = "out", depth: int = 4, least: float = 0.0) -> DataFrame:
    """Hits reached by the first transitions, in the order of (confidence falling, depth, path, node, type), of all seeds.

    Transitions that are rejected by the least confidence or as cycles count towards the budget.
    """
    steps = written(directed(edges, types, direction), "steps")
    by_depth = levels(seeds, steps, depth, least)
    every = _union([transitions(f, steps) for f in by_depth[:-1]])
    kept = every.orderBy(F.desc("confidence"), "depth", "path", "node", "via").limit(budget)
    return best_hits(kept.where(~F.col("cycle") & (F.col("confidence") >= F.lit(str(least)).cast(schema.PATH_CONFIDENCE))).drop("cycle"))


def top_paths(source: DataFrame, target: str, edges: DataFrame, types: tuple[str, ...], k: int, depth: int = 4, least: float = 0.0) -> DataFrame:
    """The best simple paths from the source (id, confidence) to the target, by (confidence falling, depth, path)."""
    steps = written(directed(edges, types, "out"), "steps")
    floor = F.lit(str(least)).cast(schema.PATH_CONFIDENCE)
    frontier, found = start(source), []
    for _ in range(depth):
        frontier = written(transitions(frontier, steps).where(~F.col("cycle") & (F.col("confidence") >= floor)).drop("cycle"), "frontier")
        found.append(frontier.where(F.col("node") == target))
        frontier = frontier.where(F.col("node") != target)
    return _union(found).orderBy(F.desc("confidence"), "depth", "path").limit(k)


def _ruled(steps: DataFrame, nodes: DataFrame, rules: dict[str, tuple[str, ...]], other: tuple[str, ...] | None = None) -> DataFrame:
    """Steps that the type of their near node admits."""
    allowed = F.lit(False)
    for kind, types in rules.items():
        if types:
            allowed = allowed | ((F.col("type") == kind) & F.col("kind").isin(*types))
    if other:
        allowed = allowed | (~F.col("type").isin(*rules) & F.col("kind").isin(*other))
    return steps.join(nodes.select(F.col("id").alias("near"), "type"), "near").where(allowed).drop("type")


def _impact(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(start, node, type, depth, confidence) of all that each start reaches, and the start of each seed (seed, start).

    Seeds whose only step leads to the same node at the same confidence share all that follows, and start as one; a seed's own
    row is among theirs if a path leads back to it.
    """
    steps = written(_ruled(directed(edges, tuple(sorted({t for v in schema.IMPACT.values() for t in v})), "in"), nodes, schema.IMPACT), "steps")
    floor = F.lit(str(least)).cast(schema.PATH_CONFIDENCE)
    one = F.lit("1").cast(schema.PATH_CONFIDENCE)

    def level(frontier: DataFrame) -> DataFrame:
        reached = frontier.join(steps, F.col("node") == F.col("near")).select("start", F.col("far").alias("node"), product(F.col("confidence"), F.col("weight")).alias("confidence")).where(F.col("confidence") >= floor)
        return reached.groupBy("start", "node").agg(F.max("confidence").alias("confidence"))

    ids = seeds.select(F.col("id").alias("seed")).distinct()
    own = ids.select(F.col("seed").alias("start"), F.col("seed").alias("node"), F.lit(0).alias("depth"), one.alias("confidence"))
    first = written(level(own).where("node <> start"), "frontier")
    only = first.groupBy("start").agg(F.count("*").alias("n"), F.min("node").alias("to"), F.min("confidence").alias("at"))
    starts = written(ids.join(only.withColumnRenamed("start", "seed"), "seed").select("seed", F.when(F.col("n") == 1, F.concat_ws("\u0001", "to", F.col("at").cast("string"))).otherwise(F.col("seed")).alias("start")), "starts")
    shared = F.col("start") != F.col("seed")
    kept = [
        written(starts.where(~shared).select("start", F.col("seed").alias("node"), F.lit(0).alias("depth"), one.alias("confidence")), "frontier"),
        written(first.withColumnRenamed("start", "seed").join(starts, "seed").select("start", "node", F.lit(1).alias("depth"), "confidence").distinct(), "frontier"),
    ]
    for d in range(2, depth + 1):
        known = _union(kept).groupBy("start", "node").agg(F.max("confidence").alias("best"))
        kept.append(written(level(kept[-1]).join(known, ["start", "node"], "left").where("best IS NULL OR confidence > best").select("start", "node", F.lit(d).alias("depth"), "confidence"), "frontier"))
    best = _union(kept[1 : depth + 1] if depth else [kept[0].limit(0)]).groupBy("start", "node").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "depth")).alias("s"))
    named = best.join(nodes.select(F.col("id").alias("node"), "type"), "node")
    return named.select("start", "node", "type", F.col("s.depth").alias("depth"), (-F.col("s.c")).cast(schema.PATH_CONFIDENCE).alias("confidence")), starts


def impact(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 4, least: float = 0.0) -> DataFrame:
    """seed, node, type, depth, confidence of everything that a seed's change can reach, against the edges.

    What a node lets pass depends on its type. A node is kept at a depth only if its confidence there is above that at every
    smaller depth; a seed dominates itself.
    """
    found, starts = _impact(seeds, nodes, edges, depth, least)
    return found.join(starts, "start").where("node <> seed").select("seed", "node", "type", "depth", "confidence")


def impact_top(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int, depth: int = 4, least: float = 0.0, kind: str | None = None) -> DataFrame:
    """impact_groups(impact(...), limit): the ranks are taken by start, with one row more for the seed itself, before starts become seeds."""
    found, starts = _impact(seeds, nodes, edges, depth, least)
    found = found.where(F.col("type") == kind) if kind else found
    order = Window.partitionBy("start", "type").orderBy("depth", "node")
    few = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit + 1).drop("rank")
    return impact_groups(few.join(starts, "start").where("node <> seed").select("seed", "node", "type", "depth", "confidence"), limit)


def impact_groups(found: DataFrame, limit: int) -> DataFrame:
    """Of each seed and node type, the first nodes by (depth, id)."""
    order = Window.partitionBy("seed", "type").orderBy("depth", "node")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def neighbourhood(seeds: DataFrame, edges: DataFrame, depth: int = 2, least: float = 0.0) -> DataFrame:
    """seed, node, confidence around seeds (id): forward over any edge, but on from there only over bridges; backward only
    over bridges, or from a seed over any edge. Confidences are products of doubles, not rounded."""
    weight = F.col("confidence").cast("double")
    bridge = F.col("type").isin(*schema.BRIDGES)
    ahead = edges.select(F.col("src").alias("near"), F.col("dst").alias("far"), weight.alias("weight"), bridge.alias("goes_on"), F.lit(False).alias("back"), bridge.alias("bridge"))
    behind = edges.select(F.col("dst").alias("near"), F.col("src").alias("far"), weight.alias("weight"), F.lit(True).alias("goes_on"), F.lit(True).alias("back"), bridge.alias("bridge"))
    steps = written(ahead.unionByName(behind), "steps")
    start_at = seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(1.0).alias("confidence"))
    kept = [written(start_at.withColumns({"expanded": F.col("confidence"), "fresh": F.lit(True)}), "frontier")]
    for d in range(depth):
        frontier = kept[-1].where("fresh").select("seed", "node", F.col("expanded").alias("reach"))
        rows = frontier.join(steps, F.col("node") == F.col("near")).where(~F.col("back") | F.col("bridge") | F.lit(d == 0)).select("seed", F.col("far").alias("node"), (F.col("reach") * F.col("weight")).alias("confidence"), F.when(F.col("goes_on"), F.col("reach") * F.col("weight")).alias("expanded")).where(F.col("confidence") >= least)
        level = rows.groupBy("seed", "node").agg(F.max("confidence").alias("confidence"), F.max("expanded").alias("expanded"))
        before = _union(kept).groupBy("seed", "node").agg(F.max("expanded").alias("was"))
        kept.append(written(level.join(before, ["seed", "node"], "left").withColumn("fresh", F.expr("coalesce(expanded IS NOT NULL AND (was IS NULL OR expanded > was), false)")).drop("was"), "frontier"))
    return _union(kept).groupBy("seed", "node").agg(F.max("confidence").alias("confidence"))


def edge_evidence_kinds(evidence: Column) -> Column:
    """Distinct sorted kinds of evidence records: rule, else source, inference, syntax, else 'source_location'."""
    return F.array_sort(F.array_distinct(F.transform(evidence, lambda e: F.coalesce(e["rule"], e["source"], e["inference"], e["syntax"], F.lit("source_location")))))


def compact_evidence(evidence: Column, limit: int) -> Column:
    """The first records, and how many are left out."""
    return F.struct(F.slice(evidence, 1, limit).alias("evidence"), F.greatest(F.size(evidence) - limit, F.lit(0)).alias("omitted"))


# dispatch roles -----------------------------------------------------------------------------------------------------------

OCCURRENCES = 256


def dispatch_roles(occurrences: Column, kinds: Column) -> Column:
    """Roles (event, job) that an edge causes: of at most 256 occurrences, those not disproved; else the edge's own kinds."""
    first = F.slice(occurrences, 1, OCCURRENCES)
    proven = F.array_sort(F.array_distinct(F.transform(F.filter(first, lambda o: F.coalesce(o["causal"], F.lit(True))), lambda o: o["kind"])))
    return F.when(F.size(occurrences) > 0, F.when(F.size(occurrences) > OCCURRENCES, F.array().cast("array<string>")).otherwise(proven)).otherwise(F.coalesce(kinds, F.array().cast("array<string>")))


def handler_role(kind: Column) -> Column:
    return F.when(kind == "listener", "event").otherwise(kind)


def dispatched(seeds: DataFrame, edges: DataFrame, depth: int = 4) -> DataFrame:
    """Traversal of executions in which a handler answers only the role that was dispatched.

    edges: (src, dst, type, confidence, roles array<string>, role, causal). A dispatch needs a role and records it in the
    state; a handler edge must not be disproved and must match it; any other edge clears it.
    """
    steps = written(edges.where(F.col("type").isin(*schema.EXECUTION)).select(F.col("src").alias("near"), F.col("dst").alias("far"), F.col("type").alias("kind"), F.col("confidence").alias("weight"), "roles", "role", "causal"), "steps")
    nothing = F.array().cast("array<string>")
    frontier = start(seeds).withColumn("state", nothing)
    out = []
    for _ in range(depth):
        rows = frontier.join(steps, F.col("node") == F.col("near"))
        dispatch, handle = F.col("kind") == "dispatches", F.col("kind") == "handled_by"
        rows = rows.where(F.when(dispatch, F.size("roles") > 0).when(handle, F.coalesce("causal", F.lit(True)) & ((F.size("state") == 0) | F.array_contains("state", F.col("role")))).otherwise(True)).where(~F.array_contains("path", F.col("far")))
        rows = rows.select("seed", F.col("far").alias("node"), (F.col("depth") + 1).alias("depth"), product(F.col("confidence"), F.col("weight")).alias("confidence"), F.concat("path", F.array("far")).alias("path"), F.col("kind").alias("via"), F.when(dispatch, F.col("roles")).otherwise(nothing).alias("state"))
        best = rows.groupBy("seed", "node", "state", "depth").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "path", "via")).alias("s"))
        frontier = written(best.select("seed", "node", "depth", (-F.col("s.c")).cast(schema.PATH_CONFIDENCE).alias("confidence"), F.col("s.path").alias("path"), F.col("s.via").alias("via"), "state"), "frontier")
        out.append(frontier.drop("state"))
    return best_hits(_union(out))
