"""Selections, ranked adjacency, search and name resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_file(nodes: DataFrame, file: str, limit: int, kind: str | None = None) -> DataFrame:
    """The file's first nodes by (line, nulls last, id), with the total and whether some are left out."""
    rows = nodes.where(F.col("file") == file)
    rows = rows.where(F.col("type") == kind) if kind else rows
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(F.asc_nulls_last("line"), "id").limit(limit).join(F.broadcast(total)).withColumn("truncated", F.col("total") > limit)


def sampled_in_file(nodes: DataFrame, file: str, limit: int) -> DataFrame:
    """Evenly spaced nodes of a file: of k, position p shows the node at p * (n - 1) div (k - 1); all if there are no more."""
    rows = nodes.where(F.col("file") == file)
    numbered = rows.withColumn("i", F.row_number().over(Window.partitionBy("file").orderBy(F.asc_nulls_last("line"), "id")) - 1)
    total = rows.agg(F.count("*").alias("n"))
    places = total.select("n", F.explode(F.when(F.col("n") <= limit, F.sequence(F.lit(0), F.greatest(F.col("n").cast("int") - 1, F.lit(0)))).otherwise(F.expr(f"transform(sequence(0, {limit - 1}), p -> cast(p * (n - 1) div {max(limit - 1, 1)} as int))"))).alias("i")).distinct()
    return numbered.join(F.broadcast(places), "i")


def edge_order(near: str, far: str) -> list[Column]:
    return [F.desc("confidence"), F.col(far), F.col("type"), F.col(near)]


def ranked_from(edges: DataFrame, types: tuple[str, ...], limit: int) -> DataFrame:
    """Of each source, its best edges of the types by (confidence falling, dst, type, src), and whether some are left out.

    The rank's limit is pushed below the shuffle, so a source with many edges sends few.
    """
    return _ranked(edges.where(F.col("type").isin(*types)), "src", "dst", limit)


def ranked_to(edges: DataFrame, types: tuple[str, ...], limit: int) -> DataFrame:
    return _ranked(edges.where(F.col("type").isin(*types)), "dst", "src", limit)


def _ranked(edges: DataFrame, near: str, far: str, limit: int) -> DataFrame:
    # one row beyond the limit tells whether the list is cut
    top = edges.withColumn("rank", F.row_number().over(Window.partitionBy(near).orderBy(*edge_order(near, far)))).where(F.col("rank") <= limit + 1)
    return top.withColumn("truncated", F.max("rank").over(Window.partitionBy(near)) > limit).where(F.col("rank") <= limit)


def ranked_from_sources(sources: DataFrame, edges: DataFrame, types: tuple[str, ...], limit: int) -> DataFrame:
    """The best edges of weighted sources (id, confidence, depth, path) altogether.

    By (rounded product falling, depth, path, source, dst, type); of repeated sources the best counts.
    """
    best = sources.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("confidence"), "depth", "path"))).where("k = 1").select(F.col("id").alias("src"), F.col("confidence").alias("own"), "depth", "path")
    reach = edges.where(F.col("type").isin(*types)).join(best, "src").withColumn("score", F.round(F.col("own") * F.col("confidence"), 4).cast("decimal(5,4)"))
    return reach.orderBy(F.desc("score"), "depth", "path", "src", "dst", "type").limit(limit)


# search -------------------------------------------------------------------------------------------------------------------


def search(nodes: DataFrame, term: str, kind: str | None = None, limit: int = 50) -> DataFrame:
    """Nodes whose id, label or name contains the term, exact before prefix before suffix before inside, then by label length.

    If none does and the term has 2 to 12 words, nodes that contain all of them.
    """
    rows = nodes.where(F.col("type") == kind) if kind else nodes
    fields = ["id", "label", "name"]
    lower = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in fields]
    t = term.lower()
    any_of = lambda test: F.greatest(*[F.coalesce(test(c), F.lit(False)) for c in lower])
    tier = F.when(any_of(lambda c: c == t), 0).when(any_of(lambda c: c.startswith(t)), 1).when(any_of(lambda c: c.endswith(t)), 2).otherwise(3)
    tokens = t.split()
    hit = any_of(lambda c: c.contains(t))
    found = rows.where(hit).withColumn("tier", tier)
    if 2 <= len(tokens) <= 12:
        every = F.lit(True)
        for x in tokens:
            every = every & any_of(lambda c, x=x: c.contains(x))
        # both in one pass: a match of the whole term anywhere hides the word matches
        both = rows.where(hit | every).withColumn("whole", hit).withColumn("tier", F.when(hit, tier).otherwise(3))
        top = both.orderBy(F.desc("whole"), "tier", F.octet_length(F.coalesce("label", F.lit(""))), "id").limit(limit)
        return top.withColumn("some", F.max("whole").over(Window.partitionBy())).where(F.col("whole") == F.col("some")).drop("whole", "some")
    return found.orderBy("tier", F.octet_length(F.coalesce("label", F.lit(""))), "id").limit(limit)


def located(nodes: DataFrame) -> DataFrame:
    """The six columns that locate a node."""
    return nodes.select("id", "type", "label", "name", "file", "line")


def resolve(nodes: DataFrame, target: str, limit: int = 10) -> DataFrame:
    """What a target names: (rank, id, resolved), the candidates of the first rank that has any; resolved if it is unique.

    Ranks: the exact id, with '@' for '::', a table, a column, a label or name (case-insensitive; views give way to others),
    and a suffix after a namespace separator (case-sensitive).
    """
    t = target.replace("@", "::")
    lower = target.lower()
    named = (F.lower("label") == lower) | (F.lower("name") == lower)
    rank = (
        F.when(F.col("id") == target, 0).when(F.col("id") == t, 1).when(F.col("id") == f"table:{target}", 2).when(F.col("id") == f"column:{target}", 3)
        .when(named & (F.col("type") != "view"), 4).when(named, 5).when(F.col("id").endswith("\\" + target), 6)
    )
    hits = nodes.withColumn("rank", rank).where("rank IS NOT NULL")
    return _winners(hits, limit)


def _winners(hits: DataFrame, limit: int) -> DataFrame:
    """The rows (rank, id) of the least rank; one beyond the limit is enough to tell whether it is one."""
    few = hits.select("rank", "id").orderBy("rank", "id").limit(limit + 1)
    every = Window.partitionBy()  # of a dozen rows
    best = few.withColumn("best", F.min("rank").over(every)).where("rank = best").withColumn("n", F.count("*").over(every))
    return best.orderBy("id").limit(limit).select("rank", "id", (F.col("n") == 1).alias("resolved"))


def resolve_historical(nodes: DataFrame, target: str) -> DataFrame:
    """The resolver of stored generations: all case-insensitive, also after '::'; '@' only when nothing else is found."""

    def hits(t: str, step: int) -> DataFrame:
        low = t.lower()
        is_ = lambda c: F.lower(c) == low
        rank = F.when(F.col("id") == t, 0).when(is_("name"), 1).when(is_("label"), 2).when(is_("id"), 3).when(F.lower("id").endswith("\\" + low), 4).when(F.lower("id").endswith("::" + low), 5)
        return nodes.select("id", (rank + step).alias("rank")).where("rank IS NOT NULL")

    found = hits(target, 0)
    if "@" in target:
        found = found.unionByName(hits(target.replace("@", "::"), 10))
    return _winners(found, 10)


def candidate_union(lists: list[DataFrame], limit: int) -> DataFrame:
    """Sorted distinct ids of several lists; one beyond the limit shows that more exist."""
    out = lists[0]
    for x in lists[1:]:
        out = out.union(x)
    return out.distinct().orderBy("id").limit(limit + 1)


#: Types that typed anchors ask for (fixed values).
ANCHORS = {"table": ("table",), "column": ("column",), "route": ("route",), "method": ("method",), "view": ("view",), "class": ("class", "event", "form_request", "job", "model", "policy", "trait")}


def resolve_anchor(nodes: DataFrame, anchor: str) -> DataFrame:
    """An anchor 'kind:target': what it resolves to, resolved only if that is of the kind; 'file:path' gives the file's first node."""
    kind, _, target = anchor.partition(":")
    if kind == "file":
        return in_file(nodes, target, 1).select(F.lit(0).alias("rank"), "id", F.lit(True).alias("resolved"))
    kinds = ANCHORS.get(kind)
    found = resolve(nodes, anchor)
    if kinds and kind not in ("table", "column"):
        # routes and views may be named by their whole id or without the kind
        found = found.unionByName(resolve(nodes, target).withColumn("rank", F.col("rank") + 10))
        found = _winners(found.where("resolved"), 10)
    if not kinds:
        return found
    return found.join(nodes.select("id", "type"), "id").select("rank", "id", (F.col("resolved") & F.col("type").isin(*kinds)).alias("resolved"))


def index_mismatches(nodes: DataFrame, searched: DataFrame) -> DataFrame:
    """Nodes (id, reason) that a search index (id, label) lacks or has under another label; none: the index is that of the nodes."""
    rows = nodes.select("id", "label").join(searched.select("id", F.col("label").alias("indexed"), F.lit(True).alias("known")), "id", "left")
    return rows.where(F.col("known").isNull() | ~F.col("label").eqNullSafe(F.col("indexed"))).select("id", F.when(F.col("known").isNull(), "missing").otherwise("label").alias("reason"))
