"""The named queries: cards, accesses, summaries, flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework import schema
from latticework.operators import index, traverse
from latticework.operators.traverse import product
from latticework.runtime import written

#: Groups of facts that a flow shows beside its methods: edge types of each (fixed values).
RELATED = {
    "formRequests": ("validates_with",),
    "models": ("uses_model",),
    "dataAccess": ("reads", "writes"),
    "dispatches": ("dispatches",),
    "sideEffects": ("reads_cache", "writes_cache", "reads_filesystem", "writes_filesystem", "calls_external"),
    "authorization": ("authorizes_via",),
    "frontendConsumers": ("consumes_route",),
    "views": ("renders",),
    "tests": ("tests_route",),
}
RELATED_FACTS = 10_000


def card(nodes: DataFrame, edges: DataFrame, target: str, limit: int = 50) -> DataFrame:
    """(direction, type, endpoint, confidence): a node's outgoing and incoming edges by (type, endpoint), limited each."""
    out = edges.where(F.col("src") == target).select(F.lit("out").alias("direction"), "type", F.col("dst").alias("endpoint"), "confidence")
    into = edges.where(F.col("dst") == target).select(F.lit("in").alias("direction"), "type", F.col("src").alias("endpoint"), "confidence")
    return out.orderBy("type", "endpoint").limit(limit).unionByName(into.orderBy("type", "endpoint").limit(limit))


def find(nodes: DataFrame, edges: DataFrame, target: str, limit: int = 50) -> DataFrame:
    """Candidates of a target: the resolver's before the search's, each once."""
    found = index.resolve(nodes, target).select("id", F.lit(0).alias("priority")).unionByName(index.search(nodes, target, None, limit).select("id", F.lit(1).alias("priority")))
    return found.groupBy("id").agg(F.min("priority").alias("priority")).join(index.located(nodes), "id").orderBy("priority", "id").limit(limit)


def table_access(edges: DataFrame, kind: str, table: str, limit: int = 50) -> DataFrame:
    """(caller, confidence) of the methods that read or write a table, by id, with the total."""
    rows = edges.where((F.col("type") == kind) & (F.col("dst") == table)).select(F.col("src").alias("caller"), "confidence")
    return rows.orderBy("caller").limit(limit).join(F.broadcast(rows.agg(F.count("*").alias("total"))))


def column_access(accesses: DataFrame, table: str, field: str, limit: int = 50) -> DataFrame:
    """(caller, verdict, total, rank): accesses of a column by verdict, which counts all before the limit.

    accesses: caller, tbl, operations array<struct<operation,fields,coverage>>.
    """
    from latticework.operators.classify import classify

    rows = accesses.where(F.col("tbl") == table).select("caller", classify(F.col("operations"), F.lit(field), F.lit(table)).alias("verdict"))
    total = rows.groupBy("verdict").agg(F.count("*").alias("total"))
    top = rows.withColumn("rank", F.row_number().over(Window.partitionBy("verdict").orderBy("caller"))).where(F.col("rank") <= limit)
    return top.join(F.broadcast(total), "verdict")


def models(nodes: DataFrame, edges: DataFrame, limit: int = 50) -> DataFrame:
    """Models by id, with their table (the smallest) and the number of their relationships (none: null)."""
    of_table = edges.where("type = 'uses_table'").groupBy("src").agg(F.min("dst").alias("tbl"))
    related = edges.where(F.col("type").isin(*schema.RELATIONSHIPS)).groupBy("src").agg(F.count("*").alias("relationships"))
    top = nodes.where("type = 'model'").orderBy("id").limit(limit)
    return top.join(of_table, top["id"] == of_table["src"], "left").drop("src").join(related, top["id"] == related["src"], "left").select("id", "label", "tbl", "relationships")


def tables(nodes: DataFrame, edges: DataFrame, limit: int = 50) -> DataFrame:
    """Tables by id, with the numbers of their columns, readers and writers (none: null)."""
    top = nodes.where("type = 'table'").orderBy("id").limit(limit).select("id")
    columns = edges.where("type = 'has_column'").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("columns"))
    access = edges.where("type IN ('reads', 'writes')").groupBy(F.col("dst").alias("id")).agg(F.expr("nullif(count_if(type = 'reads'), 0)").alias("readers"), F.expr("nullif(count_if(type = 'writes'), 0)").alias("writers"))
    return top.join(columns, "id", "left").join(access, "id", "left")


def entry(edges: DataFrame, routes: DataFrame) -> DataFrame:
    """(route, id, confidence): the strongest routes_to edge of each route (id)."""
    rows = edges.where("type = 'routes_to'").join(routes.select(F.col("id").alias("src")), "src", "left_semi")
    best = rows.groupBy("src").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "dst")).alias("s"))
    return best.select(F.col("src").alias("route"), F.col("s.dst").alias("id"), (-F.col("s.c")).cast(schema.PATH_CONFIDENCE).alias("confidence"))


def flow_methods(nodes: DataFrame, edges: DataFrame, routes: DataFrame, depth: int = 4, limit: int = 50, least: float = 0.0) -> DataFrame:
    """(route, node, depth, confidence, path): the methods a route executes, its action first."""
    actions = written(entry(edges, routes), "actions")
    hits = traverse.traverse(actions.select("id", "confidence"), edges, schema.EXECUTION, "out", depth, least)
    hits = hits.join(nodes.where("type = 'method'").select(F.col("id").alias("node")), "node", "left_semi")
    of_route = actions.select("route", F.col("id").alias("seed"))
    below = hits.join(of_route, "seed").select("route", "node", "depth", "confidence", "path")
    own = actions.select("route", F.col("id").alias("node"), F.lit(0).alias("depth"), "confidence", F.array("id").alias("path"))
    rows = own.unionByName(below)
    order = Window.partitionBy("route").orderBy(F.desc("confidence"), "depth", "path", "node")
    return rows.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= limit) | (F.col("depth") == 0)).drop("rank")


def flow_related(methods: DataFrame, edges: DataFrame, limit: int = 50, least: float = 0.0, facts: int = RELATED_FACTS) -> DataFrame:
    """(route, group, target, confidence, depth): related facts of a route's methods, the best of each target.

    The budget of facts is spent, best first, before the least confidence is applied.
    """
    group = F.lit(None).cast("string")
    for name, types in RELATED.items():
        group = F.when(F.col("type").isin(*types), F.lit(name)).otherwise(group)
    rows = methods.join(edges.select("src", "dst", "type", F.col("confidence").alias("weight")).withColumn("group", group).where("group IS NOT NULL"), F.col("node") == F.col("src"))
    rows = rows.withColumn("score", product(F.col("confidence"), F.col("weight")))
    spent = rows.withColumn("k", F.row_number().over(Window.partitionBy("route").orderBy(F.desc("score"), "depth", "path", "src", "dst", "type"))).where(F.col("k") <= facts).where(F.col("score") >= least)
    best = spent.groupBy("route", "group", F.col("dst").alias("target")).agg(F.min(F.struct((-F.col("score")).alias("c"), "depth")).alias("s")).select("route", "group", "target", (-F.col("s.c")).cast(schema.PATH_CONFIDENCE).alias("confidence"), F.col("s.depth").alias("depth"))
    order = Window.partitionBy("route", "group").orderBy(F.desc("confidence"), "depth", "target")
    return best.withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit).drop("k")


def bounded_details(operations: Column, fields: Column) -> Column:
    """At most 32 distinct operations (of the first 256) and 64 distinct fields (of the first 1024), sorted."""
    few = lambda c, source, keep: F.slice(F.array_sort(F.array_distinct(F.slice(c, 1, source))), 1, keep)
    return F.struct(few(operations, 256, 32).alias("operations"), few(fields, 1024, 64).alias("fields"))


def summarize_warnings(warnings: DataFrame, samples: int, budget: int) -> DataFrame:
    """(code, n, samples): warnings by code, with the first messages that fit a budget of bytes."""
    order = Window.partitionBy("code").orderBy("message")
    rows = warnings.withColumn("n", F.count("*").over(Window.partitionBy("code"))).withColumn("k", F.row_number().over(order)).withColumn("bytes", F.sum(F.octet_length("message")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("code").agg(F.max("n").alias("n"), F.expr(f"array_sort(collect_list(message) FILTER (WHERE k <= {samples} AND bytes <= {budget}))").alias("samples"))


def flow_warnings(methods: DataFrame, by_caller: DataFrame, samples: DataFrame) -> DataFrame:
    """(caller, reason, n): unresolved calls of the methods (id) in a flow; without any, the samples of theirs.

    by_caller: (caller, n); samples: (caller, reason).
    """
    own = methods.select(F.col("id").alias("caller")).distinct()
    summed = by_caller.join(own, "caller", "left_semi").select("caller", F.lit("unresolved_calls").alias("reason"), F.col("n").cast("long").alias("n"), F.lit(0).alias("tier"))
    sampled = samples.join(own, "caller", "left_semi").groupBy("caller", "reason").agg(F.count("*").alias("n")).withColumn("tier", F.lit(1))
    rows = summed.unionByName(sampled)
    least = rows.agg(F.min("tier").alias("best"))  # one row
    return rows.join(F.broadcast(least), F.col("tier") == F.col("best")).select("caller", "reason", "n")
