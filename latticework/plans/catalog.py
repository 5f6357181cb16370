"""The engine's queries over the relational tables, each with the SQL that gives the same rows.

The graph is that of sources.bench_graph. Parameters are those of the named queries: depths of up to 4, limits of 50.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework import schema
from latticework.functions import text
from latticework.operators import classify, diff, engine, index, merge, observe, store, traverse
from latticework.plans import planner
from latticework.runtime import written
from latticework.sources import bench_graph
from latticework.sources.bench_graph import graph, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, on_graph: bool = True) -> Callable[[Query], Query]:
    """Registers a query under its name; its SQL follows the common table expressions of the graph."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {bench_graph.SQL}{sql}" if on_graph else sql
        return f

    return register


def path_text(df: DataFrame) -> DataFrame:
    """Paths as text and confidences as doubles, the last thing done."""
    return df.withColumns({c: F.array_join(c, ">") for c, t in df.dtypes if c == "path"} | {c: F.col(c).cast("double") for c, t in df.dtypes if t.startswith("decimal")})


def seeds(df: DataFrame, column: str = "id") -> DataFrame:
    return df.select(F.col(column).alias("id"), F.lit("1").cast(schema.PATH_CONFIDENCE).alias("confidence"))


def some_methods(spark: SparkSession, sf_dir: str, every: int) -> DataFrame:
    """Methods of the orders whose key is a multiple: the query's targets, against all edges."""
    return read(spark, sf_dir, "orders").where(F.col("o_orderkey") % every == 0).select(F.concat(F.lit("method:"), F.col("o_orderkey").cast("string")).alias("id"))


# merging ------------------------------------------------------------------------------------------------------------------


@query(
    """, rows AS (
  SELECT 'method:' || o_orderkey AS id, 'method' AS type, 'method:' || o_orderkey AS label, 'app/' || o_orderstatus || '.src' AS file, CAST(o_orderkey % 500 + 1 AS INTEGER) AS line, 'orders' AS source, 1000000000 + o_orderkey AS seq FROM orders
  UNION ALL SELECT 'method:' || l_orderkey, 'unknown', 'Order ' || l_orderkey, NULL, NULL, 'lineitem', min(l_partkey * 100 + l_suppkey % 100) FROM lineitem GROUP BY l_orderkey)
SELECT id, coalesce(arg_min(type, seq) FILTER (WHERE type <> 'unknown'), 'unknown') AS type, coalesce(arg_min(label, seq) FILTER (WHERE label <> id), id) AS label, arg_min(file, seq) FILTER (WHERE file IS NOT NULL) AS file, arg_min(line, seq) FILTER (WHERE line IS NOT NULL) AS line, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM rows GROUP BY id"""
)
def node_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    a = o.select(F.concat(F.lit("method:"), key).alias("id"), F.lit("method").alias("type"), F.concat(F.lit("method:"), key).alias("label"), F.concat(F.lit("app/"), "o_orderstatus", F.lit(".src")).alias("file"), (F.col("o_orderkey") % 500 + 1).cast("int").alias("line"), F.array(F.lit("orders")).alias("sources"), (F.lit(1_000_000_000) + F.col("o_orderkey")).alias("seq"))
    item = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.col("l_partkey") * 100 + F.col("l_suppkey") % 100).alias("seq"))
    k = F.col("l_orderkey").cast("string")
    b = item.select(F.concat(F.lit("method:"), k).alias("id"), F.lit("unknown").alias("type"), F.concat(F.lit("Order "), k).alias("label"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"), F.array(F.lit("lineitem")).alias("sources"), "seq")
    return merge.merge_nodes(a.unionByName(b), ("file", "line")).withColumn("sources", F.array_join("sources", ","))


@query("SELECT src, dst, type, CAST(confidence AS DOUBLE) AS confidence FROM edges WHERE type IN ('reads', 'writes', 'calls')")
def edge_merge_max_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return path_text(graph(spark, sf_dir).edges.where("type IN ('reads', 'writes', 'calls')"))


@query(
    """SELECT l_orderkey AS o, l_partkey AS p, l_linenumber AS line, lpad(CAST(l_linenumber AS VARCHAR), 9, '0') || ':' || substr(sha256('{"line":' || l_linenumber || ',"source":"' || l_shipmode || '"}'), 1, 8) AS key FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem)""",
    on_graph=False,
)
def evidence_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = read(spark, sf_dir, "lineitem")
    payload = merge.evidence_json({"file": F.lit(None).cast("string"), "line": F.col("l_linenumber"), "source": F.concat("l_returnflag", "l_linestatus")})
    return item.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"), F.col("l_linenumber").alias("line"), merge.evidence_key(F.col("l_linenumber"), payload).alias("key"))


@query(
    """, ops AS (SELECT 'method:' || l_orderkey AS src, 'table:' || p_brand AS dst, CAST(l_linenumber AS VARCHAR) AS k, l_returnflag AS op, l_partkey * 1000 + l_quantity AS seq FROM lineitem JOIN part ON l_partkey = p_partkey),
first AS (SELECT src, dst, k, arg_min(op, (seq, op)) AS op FROM ops GROUP BY src, dst, k)
SELECT src, dst, string_agg(k || '=' || op, ',' ORDER BY k) AS operations, count(*) AS n FROM first GROUP BY src, dst"""
)
def operations_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    rows = item.select(F.concat(F.lit("method:"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("table:"), "p_brand").alias("dst"), F.col("l_linenumber").cast("string").alias("k"), F.col("l_returnflag").alias("op"), F.struct(F.col("l_partkey") * 1000 + F.col("l_quantity"), F.col("l_returnflag")).alias("seq"))
    out = merge.merge_entries(rows, ["src", "dst"], "k", "op", "seq")
    return out.select("src", "dst", F.array_join(F.transform("entries", lambda e: F.concat(e["k"], F.lit("="), e["op"])), ",").alias("operations"), F.size("entries").cast("long").alias("n"))


# index --------------------------------------------------------------------------------------------------------------------


@query("SELECT type, count(*) AS n FROM nodes GROUP BY type")
def counts_by_node_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).nodes.groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT type, count(*) AS n FROM edges GROUP BY type")
def counts_by_edge_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).edges.groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT id, line, count(*) OVER () AS total, count(*) OVER () > 50 AS truncated FROM nodes WHERE file = 'app/F.src' ORDER BY line NULLS LAST, id LIMIT 50")
def nodes_in_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.in_file(graph(spark, sf_dir).nodes, "app/F.src", 50).select("id", "line", "total", "truncated")


@query(
    """, f AS (SELECT id, row_number() OVER (ORDER BY line NULLS LAST, id) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE file = 'app/O.src')
SELECT id, i FROM f WHERE i IN (SELECT p * (n - 1) // 15 FROM range(16) r(p), (SELECT max(n) AS n FROM f))"""
)
def sampled_nodes_in_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.sampled_in_file(graph(spark, sf_dir).nodes, "app/O.src", 16).select("id", F.col("i").cast("long").alias("i"))


@query(
    """, r AS (SELECT src, dst, type, confidence, row_number() OVER (PARTITION BY src ORDER BY confidence DESC, dst, type) AS rank, count(*) OVER (PARTITION BY src) AS n FROM edges WHERE type IN ('reads', 'writes', 'uses_model'))
SELECT src, dst, type, CAST(confidence AS DOUBLE) AS confidence, CAST(rank AS INTEGER) AS rank, n > 3 AS truncated FROM r WHERE rank <= 3"""
)
def ranked_edges_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return path_text(index.ranked_from(graph(spark, sf_dir).edges, ("reads", "writes", "uses_model"), 3))


@query(
    """, r AS (SELECT src, dst, type, confidence, row_number() OVER (PARTITION BY dst ORDER BY confidence DESC, src, type) AS rank, count(*) OVER (PARTITION BY dst) AS n FROM edges WHERE type IN ('reads', 'writes'))
SELECT src, dst, type, CAST(confidence AS DOUBLE) AS confidence, CAST(rank AS INTEGER) AS rank, n > 10 AS truncated FROM r WHERE rank <= 10"""
)
def ranked_edges_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return path_text(index.ranked_to(graph(spark, sf_dir).edges, ("reads", "writes"), 10))


@query(
    """, s AS (SELECT src, dst, type, CAST(round(CAST(0.9 AS DECIMAL(5,4)) * confidence, 4) AS DECIMAL(5,4)) AS score FROM edges WHERE type IN ('reads', 'writes') AND src IN (SELECT 'method:' || o_orderkey FROM orders WHERE o_orderkey % 20 = 0))
SELECT src, dst, type, CAST(score AS DOUBLE) AS score FROM s ORDER BY s.score DESC, src, dst, type LIMIT 100"""
)
def ranked_edges_from_sources(spark: SparkSession, sf_dir: str, every: int = 20) -> DataFrame:
    s = some_methods(spark, sf_dir, every).select("id", F.lit("0.9").cast(schema.PATH_CONFIDENCE).alias("confidence"), F.lit(1).alias("depth"), F.array(F.lit("a")).alias("path"))
    return path_text(index.ranked_from_sources(s, graph(spark, sf_dir).edges, ("reads", "writes"), 100).select("src", "dst", "type", "score"))


# search and resolution ----------------------------------------------------------------------------------------------------

_TIERS = "CASE WHEN lower(id) = t OR lower(label) = t OR lower(name) = t THEN 0 WHEN starts_with(lower(id), t) OR starts_with(lower(label), t) OR starts_with(lower(name), t) THEN 1 WHEN ends_with(lower(id), t) OR ends_with(lower(label), t) OR ends_with(lower(name), t) THEN 2 ELSE 3 END"


@query(f""", q AS (SELECT *, 'brand#1' AS t FROM nodes WHERE type = 'table') SELECT id, {_TIERS} AS tier FROM q WHERE contains(lower(id), t) OR contains(lower(label), t) OR contains(lower(name), t) ORDER BY tier, strlen(label), id LIMIT 50""")
def search_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.search(graph(spark, sf_dir).nodes, "Brand#1", "table").select("id", "tier")


@query(
    """, q AS (SELECT id, label FROM nodes WHERE (contains(lower(id), 'customer') OR contains(lower(label), 'customer') OR contains(lower(name), 'customer')) AND (contains(lower(id), '7') OR contains(lower(label), '7') OR contains(lower(name), '7')))
SELECT id, 3 AS tier FROM q ORDER BY strlen(label), id LIMIT 50"""
)
def search_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.search(graph(spark, sf_dir).nodes, "customer  7", None).select("id", "tier")


@query("SELECT 2 AS rank, id, true AS resolved FROM nodes WHERE id = 'table:' || (SELECT min(p_brand) FROM part)")
def resolve_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = read(spark, sf_dir, "part").agg(F.min("p_brand")).first()[0]
    return index.resolve(graph(spark, sf_dir).nodes, brand)


@query(
    """, h AS (SELECT id, CASE WHEN id = 'METHOD:1' THEN 0 WHEN lower(name) = 'method:1' THEN 1 WHEN lower(label) = 'method:1' THEN 2 WHEN lower(id) = 'method:1' THEN 3 END AS rank FROM nodes)
SELECT rank, id, count(*) OVER () = 1 AS resolved FROM h WHERE rank = (SELECT min(rank) FROM h) ORDER BY id LIMIT 10"""
)
def resolve_historical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.resolve_historical(graph(spark, sf_dir).nodes, "METHOD:1")


@query("SELECT id, min(p) AS priority FROM (SELECT id, 0 AS p FROM nodes WHERE lower(label) = lower((SELECT min(s_name) FROM supplier)) UNION ALL SELECT id, 1 FROM (SELECT id FROM nodes WHERE contains(lower(label), lower((SELECT min(s_name) FROM supplier))))) GROUP BY id")
def find(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = read(spark, sf_dir, "supplier").agg(F.min("s_name")).first()[0]
    g = graph(spark, sf_dir)
    return engine.find(g.nodes, g.edges, name).select("id", "priority")


@query(
    """, t AS (SELECT 'method:' || min(o_orderkey) AS t FROM orders),
o AS (SELECT 'out' AS direction, type, dst AS endpoint, confidence FROM edges, t WHERE src = t ORDER BY type, dst LIMIT 50), i AS (SELECT 'in' AS direction, type, src AS endpoint, confidence FROM edges, t WHERE dst = t ORDER BY type, src LIMIT 50)
SELECT direction, type, endpoint, CAST(confidence AS DOUBLE) AS confidence FROM (SELECT * FROM o UNION ALL SELECT * FROM i)"""
)
def node_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = read(spark, sf_dir, "orders").agg(F.min("o_orderkey")).first()[0]
    g = graph(spark, sf_dir)
    return path_text(engine.card(g.nodes, g.edges, f"method:{first}"))


# traversal ----------------------------------------------------------------------------------------------------------------

_PRODUCT = "CAST(round(l.confidence * s.weight, 4) AS DECIMAL(5,4))"


def levels_sql(seeds_sql: str, types: tuple[str, ...], depth: int, least: str = "0", direction: str = "out", prefix: str = "") -> str:
    """Common table expressions <prefix>l0 to l<depth>, and hits, of a traversal from seeds (id, confidence)."""
    near, far = ("src", "dst") if direction == "out" else ("dst", "src")
    p = prefix
    out = f", {p}steps AS (SELECT {near} AS near, {far} AS far, type AS kind, confidence AS weight FROM edges WHERE type IN ({', '.join(repr(t) for t in types)})), {p}l0 AS (SELECT id AS seed, id AS node, 0 AS depth, CAST(confidence AS DECIMAL(5,4)) AS confidence, [id] AS path, CAST(NULL AS VARCHAR) AS via FROM ({seeds_sql}))"
    for d in range(1, depth + 1):
        out += f", {p}l{d} AS (SELECT seed, node, depth, confidence, path, via FROM (SELECT l.seed, s.far AS node, {d} AS depth, {_PRODUCT} AS confidence, l.path || [s.far] AS path, s.kind AS via, row_number() OVER (PARTITION BY l.seed, s.far ORDER BY {_PRODUCT} DESC, l.path || [s.far], s.kind) AS k FROM {p}l{d - 1} l JOIN {p}steps s ON l.node = s.near WHERE NOT list_contains(l.path, s.far) AND {_PRODUCT} >= {least}) WHERE k = 1)"
    every = " UNION ALL ".join(f"SELECT * FROM {p}l{d}" for d in range(1, depth + 1))
    return out + f", {p}hits AS (SELECT seed, node, depth, confidence, path, via FROM (SELECT *, row_number() OVER (PARTITION BY seed, node ORDER BY confidence DESC, depth, path, via) AS k FROM ({every}) WHERE node <> seed) WHERE k = 1)"


_EVERY = "SELECT 'method:' || o_orderkey AS id, 1 AS confidence FROM orders WHERE o_orderkey % {} = 0"
_SHOWN = "seed, node, depth, CAST(confidence AS DOUBLE) AS confidence, array_to_string(path, '>') AS path, via"


def shown(df: DataFrame) -> DataFrame:
    return path_text(df.select("seed", "node", "depth", "confidence", "path", "via"))


@query(f"{levels_sql(_EVERY.format(20), ('calls',), 5)} SELECT {_SHOWN}, EXISTS (SELECT 1 FROM l5 WHERE l5.seed = hits.seed) AS truncated FROM hits WHERE depth <= 4")
def calls_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = traverse.traverse(seeds(some_methods(spark, sf_dir, 20)), graph(spark, sf_dir).edges, ("calls",), "out", 4, limit=50)
    return path_text(hits)


@query(f"{levels_sql(_EVERY.format(20), ('calls',), 4, direction='in')} SELECT {_SHOWN} FROM hits")
def callers_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(traverse.traverse(seeds(some_methods(spark, sf_dir, 20)), graph(spark, sf_dir).edges, ("calls",), "in", 4, limit=50))


@query(f"{levels_sql(_EVERY.format(20), ('calls', 'dispatches', 'handled_by'), 4, '0.6')} SELECT {_SHOWN} FROM hits")
def traverse_min_conf(spark: SparkSession, sf_dir: str, every: int = 20) -> DataFrame:
    return shown(traverse.traverse(seeds(some_methods(spark, sf_dir, every)), graph(spark, sf_dir).edges, ("calls", "dispatches", "handled_by"), "out", 4, 0.6))


_WEIGHTED = "SELECT 'route:' || c_custkey AS id, 1 - (c_custkey % 5) / 20.0 AS confidence FROM customer WHERE c_custkey % 20 = 0"


@query(
    f"""{levels_sql(_WEIGHTED, ('routes_to', 'calls'), 3)}
SELECT {_SHOWN} FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY confidence DESC, depth, path, node) AS k FROM hits WHERE starts_with(node, 'method:')) WHERE k <= 10"""
)
def traverse_multi_seed(spark: SparkSession, sf_dir: str, every: int = 20) -> DataFrame:
    g = graph(spark, sf_dir)
    weighted = read(spark, sf_dir, "customer").where(F.col("c_custkey") % every == 0).select(F.concat(F.lit("route:"), F.col("c_custkey").cast("string")).alias("id"), (1 - (F.col("c_custkey") % 5) / 20).cast(schema.PATH_CONFIDENCE).alias("confidence"))
    return shown(traverse.traverse(weighted, g.edges, ("routes_to", "calls"), "out", 3, limit=10, results=g.nodes.where("type = 'method'")))


@query(
    f"""{levels_sql(_EVERY.format(20), ('calls', 'dispatches', 'handled_by'), 3)}
, every AS ({" UNION ALL ".join(f"SELECT l.seed, s.far AS node, {d} AS depth, {_PRODUCT} AS confidence, l.path || [s.far] AS path, s.kind AS via, list_contains(l.path, s.far) AS cycle FROM l{d - 1} l JOIN steps s ON l.node = s.near" for d in (1, 2, 3))}),
kept AS (SELECT * FROM every ORDER BY confidence DESC, depth, path, node, via LIMIT 200)
SELECT {_SHOWN} FROM (SELECT *, row_number() OVER (PARTITION BY seed, node ORDER BY confidence DESC, depth, path, via) AS k FROM kept WHERE NOT cycle AND node <> seed) WHERE k = 1"""
)
def traverse_budget(spark: SparkSession, sf_dir: str, every: int = 20) -> DataFrame:
    return shown(traverse.budgeted(seeds(some_methods(spark, sf_dir, every)), graph(spark, sf_dir).edges, ("calls", "dispatches", "handled_by"), 200, depth=3))


@query(
    """, a AS (SELECT 'route:' || min(o_custkey) AS r FROM orders), t AS (SELECT e.dst AS t FROM edges e, a WHERE e.src = r AND e.type = 'routes_to' ORDER BY 1 DESC LIMIT 1),
s AS (SELECT src, dst, confidence AS weight FROM edges WHERE type IN ('routes_to', 'calls')),
p1 AS (SELECT dst AS node, 1 AS depth, CAST(round(CAST(1 AS DECIMAL(5,4)) * weight, 4) AS DECIMAL(5,4)) AS confidence, [src, dst] AS path FROM s, a WHERE src = r),
p2 AS (SELECT s.dst AS node, 2 AS depth, CAST(round(l.confidence * s.weight, 4) AS DECIMAL(5,4)) AS confidence, l.path || [s.dst] AS path FROM p1 l JOIN s ON l.node = s.src, t WHERE l.node <> t AND NOT list_contains(l.path, s.dst)),
p3 AS (SELECT s.dst AS node, 3 AS depth, CAST(round(l.confidence * s.weight, 4) AS DECIMAL(5,4)) AS confidence, l.path || [s.dst] AS path FROM p2 l JOIN s ON l.node = s.src, t WHERE l.node <> t AND NOT list_contains(l.path, s.dst))
SELECT node, depth, CAST(confidence AS DOUBLE) AS confidence, array_to_string(path, '>') AS path FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3), t WHERE node = t ORDER BY confidence DESC, depth, path LIMIT 5"""
)
def top_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph(spark, sf_dir).edges
    route = f"route:{read(spark, sf_dir, 'orders').agg(F.min('o_custkey')).first()[0]}"
    target = edges.where((F.col("src") == route) & (F.col("type") == "routes_to")).agg(F.max("dst")).first()[0]
    source = spark.range(1).select(F.lit(route).alias("id"), F.lit("1").alias("confidence"))
    return path_text(traverse.top_paths(source, target, edges, ("routes_to", "calls"), 5, 3).select("node", "depth", "confidence", "path"))


def impact_sql(seeds_sql: str, depth: int) -> str:
    """Common table expression impact (seed, node, type, depth, confidence)."""
    rules = " OR ".join(f"(n.type = '{k}' AND e.type IN ({', '.join(repr(t) for t in v)}))" for k, v in schema.IMPACT.items())
    out = f", s AS (SELECT e.dst AS near, e.src AS far, e.confidence AS weight FROM edges e JOIN nodes n ON e.dst = n.id WHERE {rules}), k0 AS (SELECT id AS seed, id AS node, CAST(1 AS DECIMAL(5,4)) AS best FROM ({seeds_sql})), f0 AS (SELECT seed, node, 0 AS depth, best AS confidence FROM k0)"
    for d in range(1, depth + 1):
        out += f", g{d} AS (SELECT l.seed, s.far AS node, max({_PRODUCT}) AS confidence FROM f{d - 1} l JOIN s ON l.node = s.near GROUP BY 1, 2), f{d} AS (SELECT g.seed, g.node, {d} AS depth, g.confidence FROM g{d} g LEFT JOIN k{d - 1} k USING (seed, node) WHERE k.best IS NULL OR g.confidence > k.best), k{d} AS (SELECT seed, node, max(best) AS best FROM (SELECT * FROM k{d - 1} UNION ALL SELECT seed, node, confidence FROM f{d}) GROUP BY 1, 2)"
    every = " UNION ALL ".join(f"SELECT * FROM f{d}" for d in range(1, depth + 1))
    return out + f", impact AS (SELECT i.seed, i.node, n.type, i.depth, i.confidence FROM (SELECT *, row_number() OVER (PARTITION BY seed, node ORDER BY confidence DESC, depth) AS k FROM ({every})) i JOIN nodes n ON i.node = n.id WHERE k = 1)"


_COLUMNS = "SELECT 'column:' || p_brand || '.' || p_type AS id FROM part WHERE p_partkey % 20 = 0"


def some_columns(spark: SparkSession, sf_dir: str, every: int) -> DataFrame:
    return read(spark, sf_dir, "part").where(F.col("p_partkey") % every == 0).select(F.concat(F.lit("column:"), "p_brand", F.lit("."), "p_type").alias("id")).distinct()


@query(
    f"""{impact_sql(_COLUMNS.replace("SELECT", "SELECT DISTINCT", 1), 3)}
SELECT seed, node, type, depth, CAST(confidence AS DOUBLE) AS confidence, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY seed, type ORDER BY depth, node) AS k FROM impact) WHERE k <= 50"""
)
def impact_of(spark: SparkSession, sf_dir: str, every: int = 20) -> DataFrame:
    g = graph(spark, sf_dir)
    return path_text(traverse.impact_top(some_columns(spark, sf_dir, every), g.nodes, g.edges, 50, 3))


@query(
    f"""{impact_sql("SELECT DISTINCT 'table:' || p_brand AS id FROM part WHERE p_partkey % 20 = 0", 3)}
SELECT seed, node, depth, CAST(confidence AS DOUBLE) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, node) AS k FROM impact WHERE type = 'route') WHERE k <= 50"""
)
def routes_touching(spark: SparkSession, sf_dir: str, every: int = 20) -> DataFrame:
    g = graph(spark, sf_dir)
    tables = read(spark, sf_dir, "part").where(F.col("p_partkey") % every == 0).select(F.concat(F.lit("table:"), "p_brand").alias("id")).distinct()
    found = traverse.impact_top(tables, g.nodes, g.edges, 50, 3, kind="route")
    return path_text(found.select("seed", "node", "depth", "confidence"))


_ROUTES = "SELECT e.src AS route, e.dst AS id, e.confidence FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY confidence DESC, dst) AS k FROM edges WHERE type = 'routes_to') e WHERE k = 1 AND e.src IN (SELECT 'route:' || c_custkey FROM customer WHERE c_custkey % 20 = 0)"


def some_routes(spark: SparkSession, sf_dir: str, every: int) -> DataFrame:
    return read(spark, sf_dir, "customer").where(F.col("c_custkey") % every == 0).select(F.concat(F.lit("route:"), F.col("c_custkey").cast("string")).alias("id"))


_FLOW = f""", actions AS ({_ROUTES}){levels_sql("SELECT id, confidence FROM actions", schema.EXECUTION, 3)}
, flow AS (SELECT route, node, depth, confidence, path FROM (SELECT *, row_number() OVER (PARTITION BY route ORDER BY confidence DESC, depth, path, node) AS k FROM (
  SELECT route, id AS node, 0 AS depth, CAST(confidence AS DECIMAL(5,4)) AS confidence, [id] AS path FROM actions
  UNION ALL SELECT a.route, h.node, h.depth, h.confidence, h.path FROM hits h JOIN actions a ON h.seed = a.id WHERE starts_with(h.node, 'method:'))) WHERE k <= 50 OR depth = 0)"""


@query(f"{_FLOW} SELECT route, node, depth, CAST(confidence AS DOUBLE) AS confidence, array_to_string(path, '>') AS path FROM flow")
def flow_methods(spark: SparkSession, sf_dir: str, every: int = 20) -> DataFrame:
    g = graph(spark, sf_dir)
    return path_text(engine.flow_methods(g.nodes, g.edges, some_routes(spark, sf_dir, every), 3))


@query(
    f"""{_FLOW}, facts AS (SELECT f.route, f.depth, f.path, e.src, e.dst, e.type, CASE WHEN e.type = 'uses_model' THEN 'models' WHEN e.type IN ('reads', 'writes') THEN 'dataAccess' ELSE 'dispatches' END AS grp, CAST(round(f.confidence * e.confidence, 4) AS DECIMAL(5,4)) AS score FROM flow f JOIN edges e ON f.node = e.src WHERE e.type IN ('uses_model', 'reads', 'writes', 'dispatches')),
spent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY route ORDER BY score DESC, depth, path, src, dst, type) AS k FROM facts) WHERE k <= 40 AND score >= 0.5),
best AS (SELECT route, grp, dst, depth, score FROM (SELECT *, row_number() OVER (PARTITION BY route, grp, dst ORDER BY score DESC, depth) AS b FROM spent) WHERE b = 1)
SELECT route, grp AS "group", dst AS target, CAST(score AS DOUBLE) AS confidence, depth FROM (SELECT *, row_number() OVER (PARTITION BY route, grp ORDER BY score DESC, depth, dst) AS r FROM best) WHERE r <= 10"""
)
def flow_related(spark: SparkSession, sf_dir: str, every: int = 20) -> DataFrame:
    g = graph(spark, sf_dir)
    return path_text(engine.flow_related(engine.flow_methods(g.nodes, g.edges, some_routes(spark, sf_dir, every), 3), g.edges, 10, 0.5, 40))


def _neighbourhood_sql(seeds_sql: str, depth: int) -> str:
    bridge = f"type IN ({', '.join(repr(b) for b in schema.BRIDGES)})"
    out = f", st AS (SELECT src AS near, dst AS far, CAST(confidence AS DOUBLE) AS weight, {bridge} AS goes_on, false AS back, {bridge} AS bridge FROM edges UNION ALL SELECT dst, src, CAST(confidence AS DOUBLE), true, true, {bridge} FROM edges), n0 AS (SELECT id AS seed, id AS node, 1.0::DOUBLE AS confidence, 1.0::DOUBLE AS expanded FROM ({seeds_sql})), r0 AS (SELECT seed, node, confidence FROM n0)"
    for d in range(1, depth + 1):
        out += f", v{d} AS (SELECT r.seed, st.far AS node, max(r.confidence * weight) AS confidence, max(CASE WHEN goes_on THEN r.confidence * weight END) AS expanded FROM r{d - 1} r JOIN st ON r.node = st.near WHERE NOT back OR bridge OR {'true' if d == 1 else 'false'} GROUP BY 1, 2), r{d} AS (SELECT v.seed, v.node, v.expanded AS confidence FROM v{d} v LEFT JOIN n{d - 1} n USING (seed, node) WHERE v.expanded IS NOT NULL AND (n.expanded IS NULL OR v.expanded > n.expanded)), n{d} AS (SELECT seed, node, max(confidence) AS confidence, max(expanded) AS expanded FROM (SELECT * FROM n{d - 1} UNION ALL SELECT * FROM v{d}) GROUP BY 1, 2)"
    return out


@query(f"{_neighbourhood_sql(_EVERY.format(20), 2)} SELECT seed, node, confidence FROM n2")
def neighbourhood(spark: SparkSession, sf_dir: str, every: int = 20) -> DataFrame:
    return traverse.neighbourhood(some_methods(spark, sf_dir, every), graph(spark, sf_dir).edges, 2)


@query(
    """, occ AS (SELECT 'method:' || l_orderkey AS src, 'event:' || l_suppkey AS dst, list(struct_pack(kind := CASE WHEN l_returnflag = 'R' THEN 'job' ELSE 'event' END, causal := l_linestatus = 'O' OR NULL)) AS o, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT src, dst, array_to_string(list_sort(list_distinct(list_transform(list_filter(o, lambda x: coalesce(x.causal, true)), lambda x: x.kind))), ',') AS roles FROM occ"""
)
def dispatch_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = read(spark, sf_dir, "lineitem")
    causal = F.when(F.col("l_linestatus") == "O", True)
    rows = item.groupBy(F.concat(F.lit("method:"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("event:"), F.col("l_suppkey").cast("string")).alias("dst")).agg(F.collect_list(F.struct(F.when(F.col("l_returnflag") == "R", "job").otherwise("event").alias("kind"), causal.alias("causal"))).alias("o"))
    return rows.select("src", "dst", F.array_join(traverse.dispatch_roles(F.col("o"), F.lit(None).cast("array<string>")), ",").alias("roles"))


# accesses and summaries ---------------------------------------------------------------------------------------------------

_FIRST_TABLE = "(SELECT 'table:' || min(p_brand) FROM part)"


def first_table(spark: SparkSession, sf_dir: str) -> str:
    return f"table:{read(spark, sf_dir, 'part').agg(F.min('p_brand')).first()[0]}"


@query(f"SELECT src AS caller, CAST(confidence AS DOUBLE) AS confidence, count(*) OVER () AS total FROM edges WHERE type = 'writes' AND dst = {_FIRST_TABLE} ORDER BY src LIMIT 50")
def writes_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return path_text(engine.table_access(graph(spark, sf_dir).edges, "writes", first_table(spark, sf_dir)))


@query(f"SELECT src AS caller, CAST(confidence AS DOUBLE) AS confidence, count(*) OVER () AS total FROM edges WHERE type = 'reads' AND dst = {_FIRST_TABLE} ORDER BY src LIMIT 50")
def reads_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return path_text(engine.table_access(graph(spark, sf_dir).edges, "reads", first_table(spark, sf_dir)))


@query(
    """, acc AS (SELECT l_orderkey AS caller, bool_or(l_returnflag = 'R' OR (l_returnflag = 'A' AND l_linenumber = 1)) AS proven, bool_or(l_returnflag = 'N' AND l_linestatus = 'O') AS unsure FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = (SELECT min(p_brand) FROM part) GROUP BY 1),
v AS (SELECT caller, CASE WHEN proven THEN 'proven' WHEN unsure THEN 'possible' ELSE 'excluded' END AS verdict FROM acc)
SELECT caller, verdict, CAST(rank AS INTEGER) AS rank, total FROM (SELECT *, row_number() OVER (PARTITION BY verdict ORDER BY caller) AS rank, count(*) OVER (PARTITION BY verdict) AS total FROM v) WHERE rank <= 20"""
)
def column_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = first_table(spark, sf_dir).removeprefix("table:")
    item = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part").where(F.col("p_brand") == brand), F.col("l_partkey") == F.col("p_partkey"))
    coverage = F.when(F.col("l_returnflag") == "R", "whole_row").when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), "unknown").otherwise("complete")
    fields = F.when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1), F.array(F.lit(f"{brand}.price->net"))).otherwise(F.array(F.lit("other"), F.lit(f"{brand}.priceless")))
    accesses = item.groupBy(F.col("l_orderkey").alias("caller"), F.col("p_brand").alias("tbl")).agg(F.collect_list(F.struct(F.col("l_returnflag").alias("operation"), fields.alias("fields"), coverage.alias("coverage"))).alias("operations"))
    return engine.column_access(accesses, brand, "price", 20).select("caller", "verdict", "rank", "total")


@query("SELECT n.id, n.label, t.dst AS tbl, CAST(NULL AS BIGINT) AS relationships FROM (SELECT * FROM nodes WHERE type = 'model' ORDER BY id LIMIT 50) n LEFT JOIN (SELECT src, min(dst) AS dst FROM edges WHERE type = 'uses_table' GROUP BY src) t ON n.id = t.src")
def models_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return engine.models(g.nodes, g.edges)


@query("SELECT n.id, c.columns, a.readers, a.writers FROM (SELECT id FROM nodes WHERE type = 'table' ORDER BY id LIMIT 50) n LEFT JOIN (SELECT src AS id, count(*) AS columns FROM edges WHERE type = 'has_column' GROUP BY src) c USING (id) LEFT JOIN (SELECT dst AS id, nullif(count(*) FILTER (WHERE type = 'reads'), 0) AS readers, nullif(count(*) FILTER (WHERE type = 'writes'), 0) AS writers FROM edges GROUP BY dst) a USING (id)")
def tables_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return engine.tables(g.nodes, g.edges)


@query("SELECT type, CASE WHEN confidence >= 0.9 THEN NULL WHEN confidence >= 0.6 THEN 'inferred' ELSE 'low' END AS bucket, count(*) AS n FROM edges GROUP BY 1, 2")
def uncertainty_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).edges.groupBy("type", classify.uncertainty(F.col("confidence")).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT 'node' AS entity, type, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type")
def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return store.type_counts(g.nodes, g.edges)


# generations --------------------------------------------------------------------------------------------------------------


def generations(spark: SparkSession, sf_dir: str) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]:
    """Facts before (orders until 1997) and after (some orders gone, some confidences lower)."""
    g = graph(spark, sf_dir)
    orders = read(spark, sf_dir, "orders").select(F.concat(F.lit("method:"), F.col("o_orderkey").cast("string")).alias("m"), "o_orderkey", "o_orderdate")
    nodes, edges = g.nodes.where("type IN ('route', 'method')"), g.edges.where("type IN ('routes_to', 'calls', 'writes')")

    def part(keep, lower: bool) -> tuple[DataFrame, DataFrame]:
        gone = orders.where(~keep).select("m")
        n = nodes.join(gone, nodes["id"] == gone["m"], "left_anti")
        e = edges.join(gone, edges["src"] == gone["m"], "left_anti").join(gone, edges["dst"] == gone["m"], "left_anti")
        if lower:
            low = orders.where("o_orderkey % 13 = 0").select(F.col("m").alias("src"), F.lit(True).alias("low"))
            e = e.join(low, "src", "left").withColumn("confidence", F.when(F.col("low"), F.col("confidence") - F.lit("0.05").cast("decimal(9,8)")).otherwise(F.col("confidence")).cast("decimal(9,8)")).drop("low")
        return store.node_facts(n), store.edge_facts(e)

    return part(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"), False), part(F.col("o_orderkey") % 97 != 0, True)


_GENERATIONS = """, o AS (SELECT 'method:' || o_orderkey AS m, o_orderkey, o_orderdate FROM orders), gone1 AS (SELECT m FROM o WHERE NOT o_orderdate < TIMESTAMP '1997-01-01'), gone2 AS (SELECT m FROM o WHERE o_orderkey % 97 = 0),
n1 AS (SELECT id, type FROM nodes WHERE type IN ('route', 'method') AND id NOT IN (SELECT m FROM gone1)), n2 AS (SELECT id, type FROM nodes WHERE type IN ('route', 'method') AND id NOT IN (SELECT m FROM gone2)),
e1 AS (SELECT src, dst, type, confidence FROM edges WHERE type IN ('routes_to', 'calls', 'writes') AND src NOT IN (SELECT m FROM gone1) AND dst NOT IN (SELECT m FROM gone1)),
e2 AS (SELECT src, dst, type, CASE WHEN src IN (SELECT m FROM o WHERE o_orderkey % 13 = 0) THEN confidence - 0.05 ELSE confidence END AS confidence FROM edges WHERE type IN ('routes_to', 'calls', 'writes') AND src NOT IN (SELECT m FROM gone2) AND dst NOT IN (SELECT m FROM gone2)),
diff AS (SELECT 'node' AS entity, id AS identity, CASE WHEN n1.type IS NULL THEN 'added' ELSE 'removed' END AS kind, CASE WHEN coalesce(n1.type, n2.type) = 'route' THEN 'routes' ELSE 'nodes' END AS category, coalesce(n1.type, n2.type) AS type, id AS src, NULL AS dst FROM n1 FULL JOIN n2 USING (id) WHERE n1.type IS NULL OR n2.type IS NULL
  UNION ALL SELECT 'edge', src || '|' || dst || '|' || type, CASE WHEN e1.confidence IS NULL THEN 'added' WHEN e2.confidence IS NULL THEN 'removed' ELSE 'changed' END, CASE type WHEN 'writes' THEN 'writes' WHEN 'routes_to' THEN 'routes' ELSE 'edges' END, type, src, dst FROM e1 FULL JOIN e2 USING (src, dst, type) WHERE e1.confidence IS DISTINCT FROM e2.confidence)"""


@query(f"{_GENERATIONS} SELECT category, entity, kind, count(*) AS n FROM diff GROUP BY ROLLUP (category, entity, kind)")
def diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.counts(diff.changes(*generations(spark, sf_dir)))


@query(f"{_GENERATIONS} SELECT category, entity, identity, kind, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY entity, identity, CASE kind WHEN 'removed' THEN 0 WHEN 'changed' THEN 1 ELSE 2 END) AS rank FROM diff) WHERE rank <= 25")
def diff_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.details(diff.changes(*generations(spark, sf_dir)), 25).select("category", "entity", "identity", "kind", "rank")


@query(
    f"""{_GENERATIONS}, f AS (SELECT CASE WHEN category = 'routes' AND entity = 'node' AND kind = 'removed' THEN 'route_removed' WHEN type = 'routes_to' AND kind = 'removed' THEN 'route_action_removed' WHEN type = 'routes_to' AND kind = 'added' THEN 'route_action_added' WHEN category = 'routes' AND kind = 'changed' THEN 'route_semantics_changed' WHEN category = 'writes' THEN CASE kind WHEN 'changed' THEN 'write_semantics_changed' ELSE 'write_surface_' || kind END END AS code, CASE WHEN category = 'routes' THEN CASE kind WHEN 'removed' THEN 'high' ELSE 'medium' END ELSE CASE kind WHEN 'removed' THEN 'medium' ELSE 'high' END END AS severity FROM diff)
SELECT code, severity, count(*) AS n FROM f WHERE code IS NOT NULL GROUP BY 1, 2"""
)
def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.findings(diff.changes(*generations(spark, sf_dir))).groupBy("code", "severity").agg(F.count("*").alias("n"))


@query(
    f"""{_GENERATIONS}, scope AS (SELECT 'method:' || o_orderkey AS id FROM orders WHERE o_orderkey % 10 = 0 UNION SELECT {_FIRST_TABLE}), seed AS (SELECT 'method:' || o_orderkey AS id FROM orders WHERE o_orderkey % 20 = 0)
SELECT entity, identity, kind FROM diff d WHERE CASE WHEN entity = 'node' THEN src IN (SELECT id FROM scope) ELSE (src IN (SELECT id FROM scope) AND dst IN (SELECT id FROM scope)) OR (src IN (SELECT id FROM scope)) OR (dst IN (SELECT id FROM scope) AND NOT starts_with(dst, 'table:')) END"""
)
def scope_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = diff.changes(*generations(spark, sf_dir))
    scope = some_methods(spark, sf_dir, 10).unionByName(spark.range(1).select(F.lit(first_table(spark, sf_dir)).alias("id")))
    shared = graph(spark, sf_dir).nodes.where("type IN ('table', 'column', 'model')").select("id")
    return diff.in_scope(changes, scope, some_methods(spark, sf_dir, 20), shared).select("entity", "identity", "kind")


@query("SELECT 'node' AS entity, id, sha256(concat_ws(chr(0), 'node', id, type, coalesce(label, ''), coalesce(name, ''))) AS hash FROM nodes UNION ALL SELECT 'edge', src || '|' || dst || '|' || type, sha256(concat_ws(chr(0), 'edge', src, dst, type, CAST(CAST(confidence AS DECIMAL(9,4)) AS VARCHAR))) FROM edges")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    n = store.node_facts(g.nodes).select(F.lit("node").alias("entity"), "id", F.col("semantic_hash").alias("hash"))
    return n.unionByName(store.edge_facts(g.edges).select(F.lit("edge").alias("entity"), F.concat_ws("|", "src", "dst", "type").alias("id"), F.col("content_hash").alias("hash")))


def manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text", "doc_id")
    after = d.where("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return store.manifest(d.where("doc_id % 13 <> 0"), "path", "text"), store.manifest(after, "path", "text")


_MANIFESTS = "b AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS hash FROM documents WHERE doc_id % 13 <> 0), a AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 11 <> 0), c AS (SELECT path, CASE WHEN b.hash IS NULL THEN 'added' WHEN a.hash IS NULL THEN 'removed' WHEN a.hash = b.hash THEN 'unchanged' ELSE 'changed' END AS status FROM b FULL JOIN a USING (path))"


@query(f"WITH {_MANIFESTS} SELECT path, status FROM c", on_graph=False)
def source_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.source_changes(*manifests(spark, sf_dir))


@query(f"WITH {_MANIFESTS} SELECT status, count(*) AS n, array_to_string(list_slice(list_sort(list(path)), 1, 20), ',') AS paths FROM c WHERE status <> 'unchanged' GROUP BY status", on_graph=False)
def staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.staleness(*manifests(spark, sf_dir)).withColumn("paths", F.array_join("paths", ","))


@query(
    "WITH w AS (SELECT substr(l_shipdate::VARCHAR, 1, 4) AS y, l_returnflag || l_linestatus || l_linenumber AS message FROM lineitem), b AS (SELECT message, count(*) AS b FROM w WHERE y = '1995' GROUP BY 1), a AS (SELECT message, count(*) AS a FROM w WHERE y = '1996' GROUP BY 1) SELECT message, greatest(coalesce(a, 0) - coalesce(b, 0), 0) AS added, greatest(coalesce(b, 0) - coalesce(a, 0), 0) AS removed FROM b FULL JOIN a USING (message) WHERE coalesce(a, 0) <> coalesce(b, 0)",
    on_graph=False,
)
def warning_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = read(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("y"), F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("message"))
    return diff.multiset_difference(w.where("y = 1995"), w.where("y = 1996"), "message")


@query(
    "WITH m AS (SELECT DISTINCT year(o_orderdate) AS generation, o_custkey AS content_hash FROM orders), kept AS (SELECT DISTINCT generation FROM m ORDER BY 1 DESC LIMIT 2) SELECT DISTINCT content_hash FROM m WHERE content_hash NOT IN (SELECT content_hash FROM m WHERE generation IN (SELECT generation FROM kept))",
    on_graph=False,
)
def prune_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = read(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("generation"), F.col("o_custkey").alias("content_hash")).distinct()
    return store.orphans(m.select("content_hash").distinct(), m, 2)


# observations -------------------------------------------------------------------------------------------------------------


def executed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(test, file, line) of events: users are tests, kinds of events files, and every 40th event a line of some more."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("test"), F.col("event_type").alias("file"), (F.col("event_id") % 400).alias("line"))


_EXECUTED = "x AS (SELECT user_id AS test, event_type AS file, event_id % 400 AS line FROM events)"


@query(f"WITH {_EXECUTED} SELECT file, min(line) AS start, max(line) AS \"end\" FROM (SELECT file, line, line - row_number() OVER (PARTITION BY file ORDER BY line) AS i FROM (SELECT DISTINCT file, line FROM x)) GROUP BY file, i", on_graph=False)
def line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.line_ranges(executed(spark, sf_dir), ["file"])


_RANGES = "r AS (SELECT user_id % 50 AS test, event_type AS file, event_id % 5000 AS start, event_id % 5000 + CAST(floor(abs(value)) AS BIGINT) % 40 AS stop FROM events)"


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    start = F.col("event_id") % 5000
    return e.select((F.col("user_id") % 50).alias("test"), F.col("event_type").alias("file"), start.alias("start"), (start + F.floor(F.abs("value")).cast("long") % 40).alias("end"))


@query(f"WITH {_RANGES}, f AS (SELECT *, CASE WHEN start > max(stop) OVER (PARTITION BY test, file ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS fresh FROM r), i AS (SELECT *, sum(fresh) OVER (PARTITION BY test, file ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM f) SELECT test, file, min(start) AS start, max(stop) AS \"end\" FROM i GROUP BY test, file, island", on_graph=False)
def merge_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.merge_ranges(ranges(spark, sf_dir), ["test", "file"])


@query(f"WITH {_RANGES}, s AS (SELECT s_suppkey AS id, CAST(s_suppkey * 37 % 4900 AS BIGINT) AS ss, CAST(s_suppkey * 37 % 4900 + 90 AS BIGINT) AS se FROM supplier), t AS (SELECT DISTINCT file, start, stop FROM r) SELECT file, id, greatest(start, ss) AS start, least(stop, se) AS \"end\" FROM t JOIN s ON start <= se AND stop >= ss WHERE file = (SELECT min(event_type) FROM events)", on_graph=False)
def range_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = read(spark, sf_dir, "events").agg(F.min("event_type")).first()[0]
    r = ranges(spark, sf_dir).select("file", "start", "end").distinct().where(F.col("file") == one)
    at = (F.col("s_suppkey") * 37 % 4900).cast("long")
    return observe.overlaps(r, read(spark, sf_dir, "supplier").select(F.lit(one).alias("file"), F.col("s_suppkey").alias("id"), at.alias("start"), (at + 90).alias("end")), "file")


@query(f"WITH {_MANIFESTS}, x AS (SELECT CAST(user_id % 1200 AS VARCHAR) AS path, event_type FROM events), e AS (SELECT x.path, x.event_type, CASE WHEN a.hash IS NULL THEN 'missing' WHEN b.hash IS NULL THEN 'unverified' WHEN a.hash = b.hash THEN 'verified' ELSE 'stale' END AS state FROM x LEFT JOIN b USING (path) LEFT JOIN a USING (path)) SELECT path, CASE max(CASE state WHEN 'verified' THEN 0 WHEN 'unverified' THEN 1 WHEN 'stale' THEN 2 ELSE 3 END) WHEN 0 THEN 'verified' WHEN 1 THEN 'unverified' WHEN 2 THEN 'stale' ELSE 'missing' END AS state, count(*) AS n FROM e GROUP BY path", on_graph=False)
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected, current = manifests(spark, sf_dir)
    x = read(spark, sf_dir, "events").select((F.col("user_id") % 1200).cast("string").alias("path"))
    rows = x.join(expected.withColumnRenamed("hash", "expected"), "path", "left").join(current.withColumnRenamed("hash", "current"), "path", "left")
    return rows.withColumn("s", observe.freshness(F.col("expected"), F.col("current"), F.col("current").isNotNull())).groupBy("path").agg(observe.worst(F.col("s")).alias("state"), F.count("*").alias("n"))


_STATES = "CASE event_id % 7 WHEN 0 THEN 'stale' WHEN 1 THEN 'missing' WHEN 2 THEN 'unverified' ELSE 'verified' END"


@query(f"WITH x AS (SELECT CAST(user_id AS VARCHAR) AS src, event_type AS dst, {_STATES} AS f, CAST(event_id AS VARCHAR) AS o FROM events) SELECT src, dst, count(*) FILTER (WHERE f = 'verified') AS verified, count(*) FILTER (WHERE f = 'unverified') AS unverified, count(*) FILTER (WHERE f = 'stale') AS stale, count(*) FILTER (WHERE f = 'missing') AS missing, coalesce(array_to_string(list_slice(list_sort(list(DISTINCT o) FILTER (WHERE f IN ('verified', 'unverified'))), 1, 4), ','), '') AS observations, CASE WHEN count(DISTINCT f) = 1 THEN max(f) ELSE 'mixed' END AS state FROM x GROUP BY src, dst", on_graph=False)
def bucket_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("src"), F.col("event_type").alias("dst"), F.lit("runtime_covers").alias("type"), F.expr(_STATES).alias("freshness"), F.col("event_id").cast("string").alias("observation"))
    return observe.buckets(rows, 4).drop("type").withColumn("observations", F.array_join("observations", ","))


@query("WITH x AS (SELECT user_id % 100 AS test, event_type AS file, epoch_us(ts) // 86400000000 AS captured, user_id AS session, event_id % 10 AS line FROM events), b AS (SELECT test, file, max((captured, session)) AS best FROM x GROUP BY test, file) SELECT test, file, captured, session, array_to_string(list_sort(list(DISTINCT line)), ',') AS lines FROM x JOIN b USING (test, file) WHERE (captured, session) = best GROUP BY test, file, captured, session", on_graph=False)
def latest_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select((F.col("user_id") % 100).alias("test"), F.col("event_type").alias("file"), F.expr("datediff(cast(ts AS date), date'1970-01-01')").cast("long").alias("captured"), F.col("user_id").alias("session"), F.array(F.col("event_id") % 10).alias("lines"))
    return observe.latest(rows, ["test", "file"], "captured", "session", "lines").withColumn("lines", F.array_join("lines", ","))


@query("WITH x AS (SELECT user_id AS session, event_type, event_id % 50 AS test FROM events), done AS (SELECT DISTINCT session, test FROM x WHERE event_type = (SELECT min(event_type) FROM events)) SELECT session, test, count(*) AS n FROM x SEMI JOIN done USING (session, test) GROUP BY 1, 2", on_graph=False)
def finished_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    one = e.agg(F.min("event_type")).first()[0]
    x = e.select(F.col("user_id").alias("session"), "event_type", (F.col("event_id") % 50).alias("test"))
    return observe.finished_only(x, x.withColumn("kind", F.when(F.col("event_type") == one, "finished"))).groupBy("session", "test").agg(F.count("*").alias("n"))


@query("WITH x AS (SELECT file, line, unnest(tests) AS test FROM (SELECT event_type AS file, event_id % 300 AS line, list(user_id) AS tests FROM events GROUP BY 1, 2)) SELECT test, file, array_to_string(list_sort(list(DISTINCT line)), ',') AS lines FROM x GROUP BY test, file", on_graph=False)
def coverage_by_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("file"), (F.col("event_id") % 300).alias("line")).agg(F.collect_list("user_id").alias("tests"))
    return observe.coverage_by_test(x).withColumn("lines", F.array_join("lines", ","))


# texts --------------------------------------------------------------------------------------------------------------------

_STATEMENT = "'WITH recent AS (SELECT * FROM \"' || p_brand || '\") SELECT * FROM recent JOIN public.' || p_type || '_t t ON 1 = 1; UPDATE `' || p_name || '` SET x = 1; INSERT INTO main.log_' || p_size"


@query(f"WITH s AS (SELECT p_partkey, {_STATEMENT} AS q FROM part), f AS (SELECT p_partkey, unnest(regexp_extract_all(q, '(?i)\\b(?:from|into|update|join)\\s+((?:[`\"\\[]?\\w+[`\"\\]]?\\.)*[`\"\\[]?\\w+[`\"\\]]?)', 1)) AS t FROM s) SELECT p_partkey, array_to_string(list_sort(list(DISTINCT n)), ',') AS tables FROM (SELECT p_partkey, regexp_extract(lower(regexp_replace(t, '[`\"\\[\\]]', '', 'g')), '(\\w+)$', 1) AS n FROM f) WHERE n <> 'recent' GROUP BY 1", on_graph=False)
def sql_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(text.tables_in_sql(F.expr(_STATEMENT.replace('\\"', '"'))), ",").alias("tables"))


@query("SELECT page_id, len(regexp_extract_all(html, '<a [^>]*href=\"([^\"]+)\"', 1)) AS links, coalesce(array_to_string(list_slice(list_sort(list_distinct(regexp_extract_all(html, '<a [^>]*href=\"([^\"]+)\"', 1))), 1, 3), ' '), '') AS first FROM pages", on_graph=False)
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]+)"'), F.lit(1))
    return read(spark, sf_dir, "pages").select("page_id", F.size(found).cast("long").alias("links"), F.array_join(F.slice(F.array_sort(F.array_distinct(found)), 1, 3), " ").alias("first"))


@query("WITH s AS (SELECT o_orderkey, 'x = route(''orders.' || o_orderstatus || '''); axios.get(\"/orders/' || o_custkey || '?page=2\"); http.post(''/customers/' || o_custkey || '/notes'')' AS src FROM orders) SELECT o_orderkey, 'orders.' || (SELECT o_orderstatus FROM orders o WHERE o.o_orderkey = s.o_orderkey) AS names, 'GET ' || regexp_extract(src, '\\.get\\(\"([^\"]*)\"', 1) || ',POST ' || regexp_extract(src, '\\.post\\(''([^'']*)''', 1) AS urls FROM s", on_graph=False)
def route_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = F.expr("""concat("x = route('orders.", o_orderstatus, "'); axios.get(\\"/orders/", o_custkey, "?page=2\\"); http.post('/customers/", o_custkey, "/notes')")""")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(text.route_names(src), ",").alias("names"), F.array_join(F.transform(text.literal_urls(src), lambda u: F.concat_ws(" ", u["method"], u["url"])), ",").alias("urls"))


_TEMPLATES = "VALUES ('orders/{id}'), ('/orders/{id}/notes/{note?}'), ('customers/{c}'), ('customers/{c}/orders'), ('search.html')"
_TEMPLATE_ROWS = ["orders/{id}", "/orders/{id}/notes/{note?}", "customers/{c}", "customers/{c}/orders", "search.html"]


@query(
    """WITH u AS (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN '/orders/' || o_orderkey WHEN 1 THEN 'https://h.example/orders/' || o_orderkey || '/notes?x=1' WHEN 2 THEN '/orders/1/notes/' || o_orderkey || '/' WHEN 3 THEN '/customers/' || o_custkey || '/orders#top' ELSE '/searchxhtml' END AS url FROM orders),
p AS (SELECT k, regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '[?#].*$', '') AS path FROM u),
t(template, pattern) AS (VALUES ('orders/{id}', '^/?orders/[^/]+/?$'), ('/orders/{id}/notes/{note?}', '^/?orders/[^/]+/notes(?:/?[^/]+)?/?$'), ('customers/{c}', '^/?customers/[^/]+/?$'), ('customers/{c}/orders', '^/?customers/[^/]+/orders/?$'), ('search.html', '^/?search\\.html/?$'))
SELECT k, template FROM p JOIN t ON regexp_matches(path, pattern)""",
    on_graph=False,
)
def uri_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.expr("CASE o_orderkey % 5 WHEN 0 THEN concat('/orders/', o_orderkey) WHEN 1 THEN concat('https://h.example/orders/', o_orderkey, '/notes?x=1') WHEN 2 THEN concat('/orders/1/notes/', o_orderkey, '/') WHEN 3 THEN concat('/customers/', o_custkey, '/orders#top') ELSE '/searchxhtml' END")
    templates = text.with_shapes(spark.createDataFrame([(t,) for t in _TEMPLATE_ROWS], "template string"), "template").withColumn("pattern", text.uri_pattern(F.col("template")))
    paths = text.with_segments(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), text.path_of(url).alias("path")), "path")
    return text.shape_join(paths, templates, []).where(F.expr("path RLIKE pattern")).select("k", "template")


@query("SELECT p_partkey, CAST(ceil(strlen(p_name) / 4.0) AS BIGINT) AS tokens, (SELECT CAST(ceil(sum(strlen(text)) / 4.0) AS BIGINT) FROM documents) AS every FROM part", on_graph=False)
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = read(spark, sf_dir, "documents").agg(F.ceil(F.sum(F.octet_length("text")) / 4).alias("every"))
    return read(spark, sf_dir, "part").select("p_partkey", text.estimate_tokens(F.col("p_name")).alias("tokens")).join(F.broadcast(every))


_STEM = "CASE WHEN strlen(w) > 5 AND ends_with(w, 'ies') THEN w[:-4] || 'y' WHEN strlen(w) > 5 AND ends_with(w, 'ing') THEN CASE WHEN w[-4] = w[-5] THEN w[:-5] ELSE w[:-4] END WHEN strlen(w) > 4 AND ends_with(w, 'ed') THEN w[:-3] WHEN strlen(w) > 4 AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN w[:-2] ELSE w END"
_WORDS = "list_filter(regexp_split_to_array(translate(regexp_replace({}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


@query(
    f"WITH w AS (SELECT item_id, unnest({_WORDS.format('text')}) AS w, generate_subscripts({_WORDS.format('text')}, 1) AS i FROM benchmark), s AS (SELECT item_id, i, {_STEM} AS t FROM w), d AS (SELECT item_id, t, min(i) AS i FROM s WHERE t NOT IN ({', '.join(repr(x) for x in text.STOP_WORDS)}) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS k FROM d) SELECT item_id, string_agg(t, ' ' ORDER BY k) AS terms FROM k WHERE k <= 64 GROUP BY 1",
    on_graph=False,
)
def task_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.terms(F.col("text")), " ").alias("terms"))


_TASK = "Fix the customer orders of supplier 000000007 in brand pages"
_MATCHES = f"""task AS (SELECT unnest(['fix', 'customer', 'order', 'supplier', '000000007', 'brand', 'page']) AS term), x AS (SELECT id, 'id' AS f, id AS v FROM nodes UNION ALL SELECT id, 'name', coalesce(name, '') FROM nodes UNION ALL SELECT id, 'label', coalesce(label, '') FROM nodes UNION ALL SELECT id, 'file', coalesce(file, '') FROM nodes),
w AS (SELECT id, f, len({_WORDS.format('v')}) = 1 AS whole, unnest({_WORDS.format('v')}) AS w FROM x), m AS (SELECT id, {_STEM} AS term, max(CASE f WHEN 'id' THEN CASE WHEN whole THEN 1.0 ELSE 0.8 END WHEN 'name' THEN CASE WHEN whole THEN 0.98 ELSE 0.78 END WHEN 'label' THEN CASE WHEN whole THEN 0.95 ELSE 0.70 END ELSE 0.6 END)::DOUBLE AS weight FROM w GROUP BY 1, 2),
hit AS (SELECT m.* FROM m JOIN task USING (term))"""


@query(f", {_MATCHES} SELECT id, term, weight FROM hit")
def lexical_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = spark.range(1).select(F.explode(text.terms(F.lit(_TASK))).alias("term"))
    return planner.match_weights(graph(spark, sf_dir).nodes, terms)


@query(
    f""", {_MATCHES}, idf AS (SELECT term, ln(((SELECT count(*) FROM nodes) + 1) / (coalesce(n, 0) + 1)) + 1 AS idf FROM task LEFT JOIN (SELECT term, count(*) AS n FROM hit GROUP BY 1) USING (term)), r AS (SELECT id, round(least(0.90, 0.55 + 0.35 * sum(weight * idf) / (SELECT sum(idf) FROM idf)), 6) AS relevance FROM hit JOIN idf USING (term) GROUP BY id) SELECT id, relevance FROM r ORDER BY relevance DESC, id LIMIT 24"""
)
def idf_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.lexical_seeds(graph(spark, sf_dir).nodes, _TASK)


@query("SELECT n.id, CAST(coalesce(r.role, CASE n.type WHEN 'route' THEN 40 WHEN 'method' THEN 50 WHEN 'model' THEN 60 WHEN 'event' THEN 70 ELSE 55 END) AS INTEGER) AS read_rank FROM nodes n LEFT JOIN (SELECT dst, min(CASE type WHEN 'routes_to' THEN 40 ELSE 70 END) AS role FROM edges WHERE type IN ('routes_to', 'handled_by') GROUP BY dst) r ON n.id = r.dst")
def read_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return planner.read_order(g.nodes, g.edges)


@query("WITH s AS (SELECT o_custkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'explicit' WHEN 1 THEN 'lexical' WHEN 2 THEN 'identifier' ELSE 'changed_file' END AS source, (o_orderkey % 100) / 100.0 AS relevance, o_orderstatus AS term FROM orders) SELECT id, max(relevance)::DOUBLE AS relevance, CAST(min(CASE source WHEN 'explicit' THEN 0 WHEN 'changed_file' THEN 1 WHEN 'identifier' THEN 2 ELSE 3 END) AS INTEGER) AS source_rank, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, string_agg(DISTINCT term, ',' ORDER BY term) AS terms FROM s GROUP BY id", on_graph=False)
def seed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    source = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'explicit' WHEN 1 THEN 'lexical' WHEN 2 THEN 'identifier' ELSE 'changed_file' END")
    rows = o.select(F.col("o_custkey").alias("id"), source.alias("source"), ((F.col("o_orderkey") % 100) / 100).alias("relevance"), F.array("o_orderstatus").alias("terms"))
    return planner.merge_seeds(rows).withColumns({"sources": F.array_join("sources", ","), "terms": F.array_join("terms", ",")})


@query("WITH c AS (SELECT 'app/' || o_orderstatus || '/' || o_custkey % 40 AS file, o_orderkey % 3 AS priority, o_totalprice AS relevance FROM orders) SELECT file, min(priority) AS priority, max(relevance) AS relevance FROM c GROUP BY file ORDER BY 2, 3 DESC, 1 LIMIT 32", on_graph=False)
def candidate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.concat(F.lit("app/"), "o_orderstatus", F.lit("/"), (F.col("o_custkey") % 40).cast("string")).alias("file"), (F.col("o_orderkey") % 3).alias("priority"), F.col("o_totalprice").alias("relevance"))
    return planner.candidate_files(rows)


@query("SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM (SELECT user_id, ts, sum(CASE WHEN ts >= prev + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events)) GROUP BY user_id, s", on_graph=False)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from latticework.streaming.observations import sessions as of

    return of(read(spark, sf_dir, "events")).withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


# planner and packing ------------------------------------------------------------------------------------------------------


def ruled_levels_sql(seeds_sql: str, rules: dict, other: tuple[str, ...], direction: str, depth: int, prefix: str) -> str:
    """levels_sql whose steps are admitted by the type of their near node."""
    end = "src" if direction == "out" else "dst"
    allowed = " OR ".join([f"(n.type = '{k}' AND e.type IN ({', '.join(repr(t) for t in v)}))" for k, v in rules.items() if v] + ([f"(n.type NOT IN ({', '.join(repr(k) for k in rules)}) AND e.type IN ({', '.join(repr(t) for t in other)}))"] if other else []))
    plain = levels_sql(seeds_sql, ("?",), depth, direction=direction, prefix=prefix)
    return plain.replace("FROM edges WHERE type IN ('?')", f"FROM (SELECT e.* FROM edges e JOIN nodes n ON e.{end} = n.id WHERE {allowed})", 1)


_SEEDS8 = "SELECT id, CAST(relevance AS DECIMAL(5,4)) AS confidence FROM r ORDER BY relevance DESC, id LIMIT 8"
_ROLE = "CASE {} " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in planner.ROLE_WEIGHT.items()) + f" ELSE {planner.ROLE_OTHER} END"


@query(
    f""", {_MATCHES}, idf AS (SELECT term, ln(((SELECT count(*) FROM nodes) + 1) / (coalesce(n, 0) + 1)) + 1 AS idf FROM task LEFT JOIN (SELECT term, count(*) AS n FROM hit GROUP BY 1) USING (term)), r AS (SELECT id, round(least(0.90, 0.55 + 0.35 * sum(weight * idf) / (SELECT sum(idf) FROM idf)), 6) AS relevance FROM hit JOIN idf USING (term) GROUP BY id), chosen AS MATERIALIZED ({_SEEDS8})
{ruled_levels_sql("SELECT * FROM chosen", schema.DOWNSTREAM, (), "out", 2, "d")}{ruled_levels_sql("SELECT * FROM chosen", schema.UPSTREAM, schema.UPSTREAM_OTHER, "in", 2, "u")}
, every AS (SELECT id, 'seed' AS direction, 0 AS o, 0 AS depth, confidence FROM chosen UNION ALL SELECT node, 'downstream', 1, depth, confidence FROM dhits UNION ALL SELECT node, 'upstream', 2, depth, confidence FROM uhits),
scored AS (SELECT e.*, n.type, round(least(1.0, e.confidence::DOUBLE * pow(0.9, e.depth) * {_ROLE.format("n.type")}), 6) AS score FROM every e JOIN nodes n USING (id))
SELECT id, type, direction, depth, confidence::DOUBLE AS confidence, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, o, depth) AS k FROM scored) WHERE k = 1"""
)
def planner_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return path_text(planner.expand(written(planner.lexical_seeds(g.nodes, _TASK, 8), "seeds"), g.nodes, g.edges, 2))


@query()
def span_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans that a budget lets read of all documents: candidates by priority, of which the packing reads 32 files."""
    from latticework.plans.packing import FILES, Candidate, pack

    lines = read(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("file"), "text")
    candidates = lines.select("file", (F.col("doc_id") % 7 + 1).cast("int").alias("start"), (F.col("doc_id") % 7 + 3).cast("int").alias("end"), (F.col("doc_id") % 3).cast("int").alias("priority"), (1 / (1 + F.col("doc_id") % 11)).alias("relevance"))
    # the packing takes the first files by its own order; only their candidates and texts come to the driver
    first = planner.candidate_files(candidates, FILES).select("file")
    rows = candidates.join(first, "file", "left_semi").collect()
    sources = {r["file"]: (r["text"] or "").split("\n") for r in lines.join(first, "file", "left_semi").collect()}
    spans, left_out = pack([Candidate(r["file"], r["start"], r["end"], r["priority"], r["relevance"]) for r in rows], sources, 4000)
    return spark.createDataFrame([(*s, left_out) for s in spans], "file string, start int, end int, tokens int, left_out int")


@query("WITH x AS (SELECT user_id % 100 AS test, event_type AS file, epoch_us(ts) // 86400000000 AS captured_at, user_id AS session, event_id % 10 AS line FROM events), b AS (SELECT test, file, max((captured_at, session)) AS best FROM x GROUP BY test, file) SELECT test::VARCHAR AS test, file, captured_at, session, array_to_string(list_sort(list(DISTINCT line)), ',') AS lines FROM x JOIN b USING (test, file) WHERE (captured_at, session) = best GROUP BY ALL", on_graph=False)
def streaming_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files, followed and upserted batch by batch; the snapshot has the last capture of each test."""
    import uuid

    from latticework.runtime import shared_dir
    from latticework.streaming.observations import Snapshot

    root = f"{shared_dir(spark)}/observations-{uuid.uuid4().hex}"
    events = read(spark, sf_dir, "events").select(F.col("event_type").alias("file"), (F.col("user_id") % 100).cast("string").alias("test"), F.expr("datediff(cast(ts AS date), date'1970-01-01')").cast("long").alias("captured_at"), F.col("user_id").alias("session"), F.array(F.col("event_id") % 10).alias("lines"))
    events.repartition(3).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    snapshot = Snapshot(spark, f"{root}/out")
    snapshot.follow(stream, f"{root}/checkpoint").awaitTermination()
    return snapshot.read().withColumn("lines", F.array_join("lines", ","))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls_from(spark, sf_dir)
