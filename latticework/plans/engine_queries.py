"""Queries of the parts that the catalog leaves out: stores and mirrors, anchors, evidence, plans, captures, verification, the API."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework import schema
from latticework.functions import limits
from latticework.operators import classify, diff, engine, index, merge, observe, store, traverse, verify
from latticework.plans import api, planner
from latticework.plans.catalog import _FIRST_TABLE, _GENERATIONS, _MANIFESTS, _MATCHES, _TASK, _PRODUCT, first_table, generations, manifests, path_text, query, seeds, some_methods
from latticework.runtime import shared_dir, ship, written
from latticework.sources import files, json_graph
from latticework.sources.bench_graph import graph, read


def own_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# traversal with dispatch roles ----------------------------------------------------------------------------------------------

_STEPS = """, steps AS (SELECT src AS near, dst AS far, type AS kind, confidence AS weight, CASE WHEN type = 'dispatches' THEN CASE substr(dst, 7)::INT % 3 WHEN 0 THEN [] WHEN 1 THEN ['event'] ELSE ['event', 'job'] END END AS roles, CASE WHEN type = 'handled_by' THEN CASE WHEN substr(src, 7)::INT % 2 = 0 THEN 'event' ELSE 'job' END END AS role, CASE WHEN type = 'handled_by' AND substr(src, 7)::INT % 5 = 0 THEN false END AS causal FROM edges WHERE type IN ('calls', 'dispatches', 'handled_by')),
l0 AS (SELECT 'method:' || o_orderkey AS seed, 'method:' || o_orderkey AS node, 0 AS depth, CAST(1 AS DECIMAL(5,4)) AS confidence, ['method:' || o_orderkey] AS path, CAST(NULL AS VARCHAR) AS via, CAST([] AS VARCHAR[]) AS state FROM orders WHERE o_orderkey % 20 = 0)"""


def _role_levels(depth: int) -> str:
    out = _STEPS
    for d in range(1, depth + 1):
        out += f", l{d} AS (SELECT seed, node, depth, confidence, path, via, state FROM (SELECT l.seed, s.far AS node, {d} AS depth, {_PRODUCT} AS confidence, l.path || [s.far] AS path, s.kind AS via, CASE WHEN s.kind = 'dispatches' THEN s.roles ELSE [] END AS state, row_number() OVER (PARTITION BY l.seed, s.far, CASE WHEN s.kind = 'dispatches' THEN s.roles ELSE [] END ORDER BY {_PRODUCT} DESC, l.path || [s.far], s.kind) AS k FROM l{d - 1} l JOIN steps s ON l.node = s.near WHERE NOT list_contains(l.path, s.far) AND CASE s.kind WHEN 'dispatches' THEN len(s.roles) > 0 WHEN 'handled_by' THEN coalesce(s.causal, true) AND (len(l.state) = 0 OR list_contains(l.state, s.role)) ELSE true END) WHERE k = 1)"
    return out


@query(f"{_role_levels(3)} SELECT seed, node, depth, confidence::DOUBLE AS confidence, array_to_string(path, '>') AS path, via FROM (SELECT *, row_number() OVER (PARTITION BY seed, node ORDER BY confidence DESC, depth, path, via) AS k FROM ({' UNION ALL '.join(f'SELECT * FROM l{d}' for d in (1, 2, 3))}) WHERE node <> seed) WHERE k = 1")
def dispatched_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda c: F.expr(f"cast(substring({c}, 7) AS int)")
    roles = F.when(number("dst") % 3 == 0, F.array().cast("array<string>")).when(number("dst") % 3 == 1, F.array(F.lit("event"))).otherwise(F.array(F.lit("event"), F.lit("job")))
    handled = F.col("type") == "handled_by"
    edges = graph(spark, sf_dir).edges.where("type IN ('calls', 'dispatches', 'handled_by')").withColumns({"roles": F.when(F.col("type") == "dispatches", roles), "role": F.when(handled, F.when(number("src") % 2 == 0, "event").otherwise("job")), "causal": F.when(handled & (number("src") % 5 == 0), False)})
    return path_text(traverse.dispatched(seeds(some_methods(spark, sf_dir, 20)), edges, 3))


# stores and mirrors ---------------------------------------------------------------------------------------------------------

_TWO = "SELECT 1 AS generation, 'node' AS entity, type, count(*) AS n FROM n1 GROUP BY type UNION ALL SELECT 1, 'edge', type, count(*) FROM e1 GROUP BY type UNION ALL SELECT 2, 'node', type, count(*) FROM n2 GROUP BY type UNION ALL SELECT 2, 'edge', type, count(*) FROM e2 GROUP BY type"


def _stored(spark: SparkSession, sf_dir: str) -> store.Store:
    s = store.Store(spark, own_folder(spark, "store"))
    hashes = ("content_hash", "semantic_hash")
    for nodes, edges in generations(spark, sf_dir):
        s.publish(nodes.drop(*hashes), edges.drop(*hashes))
    return s


@query(f"{_GENERATIONS} {_TWO}")
def published_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two generations published, the second twice, and both loaded again, with their facts checked."""
    s = _stored(spark, sf_dir)
    again = s.publish(*(f.drop("content_hash", "semantic_hash") for f in s.load()))
    assert again["id"] == s.current()["id"] == 2 and [g["parent"] for g in s.generations()] == [1, None]
    out = None
    for g in (1, 2):
        counts = store.type_counts(*s.load(g)).withColumn("generation", F.lit(g))
        out = counts if out is None else out.unionByName(counts)
    return out


@query("SELECT sha256(string_agg(h, '' ORDER BY b)) AS fingerprint FROM (SELECT substr(h, 1, 2) AS b, sha256(string_agg(h, '' ORDER BY h)) AS h FROM (SELECT sha256(concat_ws(chr(0), 'node', id, type, coalesce(label, ''), coalesce(name, ''), coalesce(file, ''), coalesce(line::VARCHAR, ''), coalesce(end_line::VARCHAR, ''))) AS h FROM nodes) GROUP BY 1)")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.bucket_fingerprint(store.node_facts(graph(spark, sf_dir).nodes))


@query("SELECT sha256(string_agg(h, chr(10) ORDER BY type, id)) AS fingerprint FROM (SELECT type, id, sha256(concat_ws(chr(0), 'node', id, type, coalesce(label, ''), coalesce(name, ''), coalesce(file, ''), coalesce(line::VARCHAR, ''), coalesce(end_line::VARCHAR, ''))) AS h FROM nodes WHERE type IN ('table', 'event'))")
def sequential_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return store.exact_fingerprint(store.node_facts(g.nodes.where("type IN ('table', 'event')")), store.edge_facts(g.edges.where("false")))


@query("SELECT id FROM nodes WHERE type = 'route' AND substr(id, 7)::INT % 50 = 0")
def broken_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = store.node_facts(graph(spark, sf_dir).nodes)
    changed = (F.col("type") == "route") & (F.expr("try_cast(substring(id, 7) AS int)") % 50 == 0)
    stored = facts.withColumn("label", F.when(changed, F.concat("label", F.lit("!"))).otherwise(F.col("label")))
    return store.broken(stored, store.node_facts(stored.drop("content_hash", "semantic_hash"))).select("id")


@query("SELECT DISTINCT 'h' || p_size AS content_hash FROM part WHERE p_size % 3 > 0", on_graph=False)
def new_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.concat(F.lit("h"), F.col("p_size").cast("string")).alias("content_hash"), "p_size")
    return store.new_objects(p, p.where("p_size % 3 = 0").distinct()).select("content_hash")


@query("SELECT DISTINCT o_custkey AS generation FROM orders WHERE o_custkey < 100 ORDER BY 1 DESC LIMIT 21", on_graph=False)
def generation_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.page(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("generation")).distinct(), 20, 100)


@query("SELECT id, type, label, name, file, line, end_line FROM nodes WHERE type <> 'model'")
def json_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that were exported to a mirror and loaded from it."""
    g = graph(spark, sf_dir)
    path = own_folder(spark, "mirror")
    json_graph.export(g.nodes.where("type <> 'model'"), g.edges.where("type = 'handled_by'"), path)
    return json_graph.load(spark, path)[0]


@query("SELECT src, dst, type, confidence::DOUBLE AS confidence FROM edges WHERE type = 'handled_by'")
def json_mirror_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    path = own_folder(spark, "mirror")
    json_graph.export(g.nodes.where("type = 'event'"), g.edges.where("type = 'handled_by'"), path)
    return path_text(json_graph.load(spark, path)[1])


@query("SELECT 'parquet' AS kind, 14 AS n", on_graph=False)
def found_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables' own files, found below their folder by an extension in any case."""
    found = files.find_files(spark, [sf_dir], ("PARQUET",)).select(F.regexp_extract("path", r"([^/]+)\.parquet", 1).alias("t"), F.length("hash").alias("digits")).where("digits = 64 AND t <> ''")
    return found.agg(F.count_distinct("t").alias("n")).select(F.lit("parquet").alias("kind"), "n")


# index and anchors ----------------------------------------------------------------------------------------------------------


@query("SELECT id, line, count(*) OVER () AS total, count(*) OVER () > 20 AS truncated FROM nodes WHERE file = 'app/P.src' AND type = 'method' ORDER BY line NULLS LAST, id LIMIT 20")
def nodes_of_type_in_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.in_file(graph(spark, sf_dir).nodes, "app/P.src", 20, "method").select("id", "line", "total", "truncated")


@query("SELECT id FROM (SELECT id FROM nodes WHERE type = 'table' UNION SELECT id FROM nodes WHERE type = 'event') ORDER BY id LIMIT 11")
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = graph(spark, sf_dir).nodes
    return index.candidate_union([n.where("type = 'table'").select("id"), n.where("type = 'event'").select("id"), n.where("type = 'table'").select("id")], 10)


@query(f"SELECT 'table' AS anchor, {_FIRST_TABLE} AS id, true AS resolved UNION ALL SELECT 'file', (SELECT id FROM nodes WHERE file = 'app/F.src' ORDER BY line NULLS LAST, id LIMIT 1), true UNION ALL SELECT 'route', (SELECT id FROM nodes WHERE type = 'route' AND label = (SELECT min(c_name) FROM customer)), true")
def resolved_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = graph(spark, sf_dir).nodes
    customer = read(spark, sf_dir, "customer").agg(F.min("c_name")).first()[0]
    out = None
    for anchor in (first_table(spark, sf_dir), "file:app/F.src", f"route:{customer}"):
        found = index.resolve_anchor(n, anchor).select(F.lit(anchor.partition(":")[0]).alias("anchor"), "id", "resolved")
        out = found if out is None else out.unionByName(found)
    return out


@query("SELECT id, CASE WHEN type = 'route' THEN 'missing' ELSE 'label' END AS reason FROM nodes WHERE (type = 'route' AND substr(id, 7)::INT % 10 = 0) OR type = 'event'")
def index_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = graph(spark, sf_dir).nodes
    searched = n.where("NOT (type = 'route' AND coalesce(try_cast(substring(id, 7) AS int) % 10 = 0, false))").select("id", F.when(F.col("type") == "event", F.lower("label")).otherwise(F.col("label")).alias("label"))
    return index.index_mismatches(n, searched)


@query(
    """, r AS (SELECT o_custkey % 50 AS grp, o_orderpriority || o_orderstatus AS value, o_totalprice AS confidence, o_orderkey % 4 AS depth, o_orderkey AS id FROM orders), b AS (SELECT *, row_number() OVER (PARTITION BY grp, value ORDER BY confidence DESC, depth, id) AS k FROM r), t AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY confidence DESC, depth, id) AS j, count(*) OVER (PARTITION BY grp) AS n FROM b WHERE k = 1)
SELECT grp, string_agg(value, ',' ORDER BY value) AS values, max(n) > 4 AS truncated FROM t WHERE j <= 4 GROUP BY grp"""
)
def ranked_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("grp"), F.concat("o_orderpriority", "o_orderstatus").alias("value"), F.col("o_totalprice").alias("confidence"), (F.col("o_orderkey") % 4).alias("depth"), F.col("o_orderkey").alias("id"))
    return merge.compact_ranked(r, "grp", "value", 4).withColumn("values", F.array_join("values", ","))


# evidence, warnings, limits -------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, string_agg(DISTINCT CASE l_linenumber % 3 WHEN 0 THEN 'r' || l_returnflag WHEN 1 THEN 's' || l_linestatus ELSE 'source_location' END, ',' ORDER BY CASE l_linenumber % 3 WHEN 0 THEN 'r' || l_returnflag WHEN 1 THEN 's' || l_linestatus ELSE 'source_location' END) AS kinds, greatest(count(*) - 2, 0) AS omitted FROM lineitem GROUP BY 1", on_graph=False)
def evidence_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    n = F.col("l_linenumber")
    record = F.struct(F.when(n % 3 == 0, F.concat(F.lit("r"), "l_returnflag")).alias("rule"), F.when(n % 3 == 1, F.concat(F.lit("s"), "l_linestatus")).alias("source"), none.alias("inference"), none.alias("syntax"))
    e = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(record).alias("e"))
    return e.select("l_orderkey", F.array_join(traverse.edge_evidence_kinds(F.col("e")), ",").alias("kinds"), traverse.compact_evidence(F.col("e"), 2)["omitted"].cast("long").alias("omitted"))


@query("SELECT l_suppkey, l_linenumber, array_to_string(list_slice(list_sort(list(DISTINCT l_shipdate::DATE::VARCHAR)), 1, 32), ',') AS operations, array_to_string(list_slice(list_sort(list(DISTINCT l_partkey)), 1, 64), ',') AS fields FROM lineitem GROUP BY ALL HAVING count(*) <= 256", on_graph=False)
def bounded_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n"), F.collect_list(F.col("l_shipdate").cast("date").cast("string")).alias("o"), F.collect_list("l_partkey").alias("f")).where("n <= 256")
    return item.select("l_suppkey", "l_linenumber", engine.bounded_details(F.col("o"), F.col("f")).alias("d")).select("l_suppkey", "l_linenumber", F.array_join("d.operations", ",").alias("operations"), F.array_join("d.fields", ",").alias("fields"))


@query("WITH w AS (SELECT o_orderstatus AS code, o_orderpriority || ' ' || o_custkey AS message FROM orders), r AS (SELECT *, count(*) OVER (PARTITION BY code) AS n, row_number() OVER (PARTITION BY code ORDER BY message) AS k, sum(strlen(message)) OVER (PARTITION BY code ORDER BY message ROWS UNBOUNDED PRECEDING) AS bytes FROM w) SELECT code, max(n) AS n, coalesce(string_agg(message, '|' ORDER BY message) FILTER (WHERE k <= 8 AND bytes <= 60), '') AS samples FROM r GROUP BY code", on_graph=False)
def warning_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("code"), F.concat_ws(" ", "o_orderpriority", F.col("o_custkey").cast("string")).alias("message"))
    return engine.summarize_warnings(w, 8, 60).withColumn("samples", F.array_join("samples", "|"))


@query("WITH c AS (SELECT 'method:' || o_orderkey AS caller, o_orderkey % 5 AS n FROM orders WHERE o_orderkey % 5 > 0), m AS (SELECT 'method:' || o_orderkey AS id FROM orders WHERE o_orderkey % 20 < 7) SELECT caller, 'unresolved_calls' AS reason, n FROM c WHERE caller IN (SELECT id FROM m)", on_graph=False)
def flow_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    key = F.concat(F.lit("method:"), F.col("o_orderkey").cast("string"))
    by_caller = o.where("o_orderkey % 5 > 0").select(key.alias("caller"), (F.col("o_orderkey") % 5).alias("n"))
    return engine.flow_warnings(o.where("o_orderkey % 20 < 7").select(key.alias("id")), by_caller, o.select(key.alias("caller"), F.lit("dynamic").alias("reason")))


@query("WITH d AS (SELECT 'method:' || l_orderkey AS caller, 'r' || lpad((l_partkey % 30)::VARCHAR, 2, '0') AS reason, sum(l_linenumber) AS n FROM lineitem WHERE l_orderkey % 20 = 0 GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY caller ORDER BY reason) AS k FROM d) SELECT caller, sum(n)::BIGINT AS n, string_agg(reason || '=' || n, ',' ORDER BY reason) FILTER (WHERE k <= 3) AS reasons, max(k) > 3 AS truncated FROM k GROUP BY caller", on_graph=False)
def call_uncertainties(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("method:"), F.col("l_orderkey").cast("string")).alias("caller"), F.concat(F.lit("r"), F.lpad((F.col("l_partkey") % 30).cast("string"), 2, "0")).alias("reason"), F.col("l_linenumber").alias("n"))
    contexts = some_methods(spark, sf_dir, 20).withColumn("type", F.lit("method")).unionByName(spark.range(1).select(F.lit("method:1").alias("id"), F.lit("table").alias("type")))
    found = planner.call_uncertainties(contexts, d, 3)
    return found.withColumn("reasons", F.array_join(F.transform("reasons", lambda r: F.concat(r["reason"], F.lit("="), r["n"].cast("string"))), ","))


@query("SELECT p_partkey, 'save order ' || lower(regexp_replace(p_brand, '[^A-Za-z0-9]+', ' ', 'g')) AS terms FROM part", on_graph=False)
def supplemental_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [F.array(F.lit("saveOrder()")), F.array(F.col("p_brand"), F.lit(None).cast("string")), F.array(F.lit("orders"))]
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(planner.supplemental_tokens(fields), " ").alias("terms"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE '/a~1b/' || o_orderkey % 4 || ',' END || CASE WHEN o_orderkey % 5 = 0 THEN '/gone' ELSE '' END AS paths FROM orders", on_graph=False)
def changed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON pointers of what differs between two documents of every order."""
    import pandas as pd

    ship(spark)

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"o_orderkey": f["o_orderkey"], "paths": ["".join(p + ("," if p.startswith("/a") else "") for p in limits.changed_paths(json.loads(b), json.loads(a))[0]) for b, a in zip(f["before"], f["after"], strict=True)]})

    k = F.col("o_orderkey")
    items = lambda change: F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(change & (i == k % 4), "9").otherwise(i.cast("string"))), ","), F.lit("]"))
    before = F.concat(F.lit('{"a/b":'), items(F.lit(False)), F.when(k % 5 == 0, ',"gone":1').otherwise(""), F.lit(',"z":{"y":null}}'))
    after = F.concat(F.lit('{"a/b":'), items(F.col("o_custkey") % 3 > 0), F.lit(',"z":{"y":null}}'))
    return read(spark, sf_dir, "orders").select("o_orderkey", before.alias("before"), after.alias("after")).mapInPandas(run, "o_orderkey long, paths string")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '[' || c_custkey || ',\"' || c_name || '\"]' ELSE '[' || c_custkey || ']' END AS kept, CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1 END AS omitted FROM customer", on_graph=False)
def compacted_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of each customer within a budget of bytes that holds its second item, or only the first."""
    import pandas as pd

    ship(spark)

    def run(frames):
        for f in frames:
            cut = [limits.compact([int(k), n], 200 if k % 2 == 0 else 4 + len(str(k))) for k, n in zip(f["c_custkey"], f["c_name"], strict=True)]
            yield pd.DataFrame({"c_custkey": f["c_custkey"], "kept": [limits.encode(v) for v, _ in cut], "omitted": [o for _, o in cut]})

    return read(spark, sf_dir, "customer").select("c_custkey", "c_name").mapInPandas(run, "c_custkey long, kept string, omitted int")


# plans ----------------------------------------------------------------------------------------------------------------------


@query(
    """, acc AS (SELECT l_orderkey AS caller, bool_or(l_returnflag = 'R') AS proven, bool_or(l_returnflag = 'N' AND l_linestatus = 'O') AS unsure FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = (SELECT min(p_brand) FROM part) GROUP BY 1)
SELECT caller, tier, CAST(row_number() OVER (PARTITION BY tier ORDER BY caller) AS INTEGER) AS rank FROM (SELECT caller, CASE WHEN proven THEN 'proven' WHEN unsure THEN 'possible' END AS tier FROM acc) WHERE tier IS NOT NULL"""
)
def table_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = first_table(spark, sf_dir).removeprefix("table:")
    item = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part").where(F.col("p_brand") == brand), F.col("l_partkey") == F.col("p_partkey"))
    coverage = F.when(F.col("l_returnflag") == "R", "whole_row").when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), "unknown").otherwise("complete")
    a = item.groupBy(F.col("l_orderkey").alias("caller"), F.col("p_brand").alias("tbl")).agg(F.collect_list(F.struct(F.col("l_returnflag").alias("operation"), F.array(F.lit("other")).alias("fields"), coverage.alias("coverage"))).alias("operations"))
    return planner.table_contexts(a, brand, "price").select("caller", "tier", "rank")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'possible' WHEN o_orderkey % 4 = 1 THEN 'possible' WHEN o_orderkey % 4 = 2 THEN 'proven' ELSE 'excluded' END AS verdict FROM orders", on_graph=False)
def capped_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accesses by their first operations: none, more than the cap allows to exclude, one that names the column, and others."""
    k = F.col("o_orderkey")
    op = lambda field: F.struct(F.lit("get").alias("operation"), F.array(F.lit(field)).alias("fields"), F.lit("complete").alias("coverage"))
    operations = F.when(k % 4 == 0, F.array().cast("array<struct<operation:string,fields:array<string>,coverage:string>>")).when(k % 4 == 1, F.array_repeat(op("other"), 5)).when(k % 4 == 2, F.array(op("other"), op("t.price->net"))).otherwise(F.array(op("other")))
    return read(spark, sf_dir, "orders").select("o_orderkey", classify.classify(operations, F.lit("price"), F.lit("t"), 4).alias("verdict"))


@query(
    """, h AS (SELECT CASE o_orderkey % 2 WHEN 0 THEN 'downstream' ELSE 'upstream' END AS direction, ['p' || o_custkey % 60, 'q' || o_orderkey % 2] AS path, max(round(o_totalprice / 1000000, 4)) AS confidence, 2 AS depth, o_custkey % 60 % 5 AS evidence FROM orders GROUP BY ALL),
t AS (SELECT * FROM h ORDER BY confidence DESC, depth, path LIMIT 32) SELECT direction, array_to_string(path, '>') AS path, confidence, evidence::INTEGER AS evidence FROM (SELECT *, sum(evidence) OVER (ORDER BY confidence DESC, depth, path ROWS UNBOUNDED PRECEDING) AS spent FROM t) WHERE spent <= 40"""
)
def shown_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 60
    hits = read(spark, sf_dir, "orders").select(F.when(k % 2 == 0, "downstream").otherwise("upstream").alias("direction"), F.array(F.concat(F.lit("p"), c.cast("string")), F.concat(F.lit("q"), (k % 2).cast("string"))).alias("path"), F.round(F.col("o_totalprice") / 1000000, 4).alias("confidence"), F.lit(2).alias("depth"), (c % 5).cast("int").alias("evidence"))
    return path_text(planner.shown_paths(hits, 32, 40).select("direction", "path", "confidence", "evidence"))


@query("SELECT 't' || l_suppkey AS test, max(l_discount) AS confidence, string_agg(DISTINCT 'method:' || l_orderkey, ',' ORDER BY 'method:' || l_orderkey) AS routes FROM lineitem WHERE l_orderkey % 20 = 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 32", on_graph=False)
def mapped_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("t"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("method:"), F.col("l_orderkey").cast("string")).alias("dst"), F.when(F.col("l_linenumber") % 2 == 0, "tests_route").otherwise("runtime_covers").alias("type"), F.col("l_discount").alias("confidence"))
    return planner.mapped_tests(some_methods(spark, sf_dir, 20), links).withColumn("routes", F.array_join("routes", ","))


@query("SELECT o_orderstatus AS code, sum(o_custkey)::BIGINT AS n, min(o_orderpriority) AS location FROM orders GROUP BY 1", on_graph=False)
def plan_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.gaps(read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("code"), F.col("o_custkey").alias("n"), F.col("o_orderpriority").alias("location")))


@query("WITH u AS (SELECT DISTINCT o_orderstatus AS reason, o_custkey AS subject FROM orders) SELECT reason, subject, count(*) OVER (PARTITION BY reason) AS of_reason FROM u ORDER BY reason, subject LIMIT 50", on_graph=False)
def bounded_uncertainties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.bounded_uncertainties(read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("reason"), F.col("o_custkey").alias("subject")))


@query(", s AS (SELECT id, (length(id) * 7 % 10) / 10.0 AS relevance, length(label) % 3 AS source_rank, type, file, line FROM nodes) SELECT id, relevance::DOUBLE AS relevance, source_rank::INTEGER AS source_rank FROM s ORDER BY source_rank, relevance DESC, CASE type WHEN 'route' THEN 0 WHEN 'method' THEN 1 WHEN 'model' THEN 3 WHEN 'event' THEN 3 ELSE 5 END, coalesce(file, ''), line NULLS LAST, id LIMIT 500")
def ordered_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = graph(spark, sf_dir).nodes
    s = n.select("id", (F.length("id") * 7 % 10 / 10).alias("relevance"), (F.length("label") % 3).cast("int").alias("source_rank"))
    return planner.ordered_seeds(s, n).limit(500).select("id", "relevance", "source_rank")


@query(
    """SELECT file, line AS start, end_line AS "end", CASE WHEN substr(id, 8)::INT % 3 = 0 THEN 0 ELSE 2 END AS priority, (substr(id, 8)::INT % 10 / 10.0)::DOUBLE AS relevance FROM nodes WHERE type = 'method' AND substr(id, 8)::INT % 20 = 0
UNION ALL SELECT file, line, end_line, 2, 0.85 * 0.9 FROM nodes WHERE id = 'method:1' UNION ALL SELECT 'app/x.src', NULL, NULL, 1, 1.0"""
)
def span_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = graph(spark, sf_dir).nodes
    number = F.expr("cast(substring(id, 8) AS int)")
    contexts = some_methods(spark, sf_dir, 20).select("id", F.when(number % 3 == 0, "seed").otherwise("upstream").alias("direction"), (number % 10 / 10).alias("score"))
    tests = spark.createDataFrame([("method:1", 0.9)], "test string, confidence double")
    return planner.span_candidates(contexts, n, tests, ["app/x.src", "vendor/y.src"])


@query(
    f""", {_MATCHES}, own AS (SELECT * FROM nodes WHERE file = 'app/O.src'), best AS (SELECT id FROM own JOIN (SELECT id, sum(weight) AS score FROM hit GROUP BY 1) USING (id) ORDER BY score DESC, line NULLS LAST, id LIMIT 8),
rest AS (SELECT id, row_number() OVER (ORDER BY line NULLS LAST, id) - 1 AS i, count(*) OVER () AS n FROM own WHERE id NOT IN (SELECT id FROM best)) SELECT id, 0.98::DOUBLE AS relevance FROM best UNION ALL SELECT id, 0.98 FROM rest WHERE i IN (SELECT p * (n - 1) // 7 FROM range(8) r(p), (SELECT max(n) AS n FROM rest))"""
)
def changed_file_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = graph(spark, sf_dir).nodes
    from latticework.functions import text

    matches = planner.match_weights(n, spark.range(1).select(F.explode(text.terms(F.lit(_TASK))).alias("term")))
    return planner.changed_file_nodes(n, matches, "app/O.src", 16)


@query(f""", keys AS (SELECT id, unnest([lower(id), lower(label), lower(name)]) AS k FROM nodes) SELECT DISTINCT id, 0.92::DOUBLE AS relevance FROM keys WHERE k IN (lower({_FIRST_TABLE}), (SELECT lower(min(c_name)) FROM customer))""")
def identifier_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([(first_table(spark, sf_dir).lower(),), (read(spark, sf_dir, "customer").agg(F.min("c_name")).first()[0].lower(),)], "term string")
    return planner.identifier_seeds(graph(spark, sf_dir).nodes, wanted)


@query()
def discovered_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = graph(spark, sf_dir).nodes
    found = planner.discover(n, _TASK, n.where("id = 'method:1'").select("id"), ["app/F.src"])
    return found.withColumns({"sources": F.array_join("sources", ","), "terms": F.array_join("terms", ",")})


# captures -------------------------------------------------------------------------------------------------------------------


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures read from JSON lines: a test of each user, the kinds of its events as files, with ranges of ten lines."""
    e = read(spark, sf_dir, "events")
    start = (F.col("event_id") % 300 + 1).cast("short")  # small to group, and ranges afterwards
    source = e.groupBy("user_id", "event_type").agg(F.collect_set(start).alias("starts"))
    rows = source.groupBy("user_id").agg(F.collect_list(F.struct("event_type", "starts")).alias("by_type"))
    ranges = lambda starts: F.transform(F.array_sort(starts), lambda x: F.array(x.cast("int"), x.cast("int") + 9))
    good = lambda s: F.struct(s["event_type"].alias("file"), F.concat(F.lit("h"), s["event_type"]).alias("sha256"), F.concat(ranges(s["starts"]), F.array(F.array(F.lit(0), F.lit(3)), F.array(F.lit(9), F.lit(2)))).alias("ranges"))
    rows = rows.withColumn("sources", F.transform("by_type", good))
    path = own_folder(spark, "captures")
    rows.select(F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("test"), F.lit("tests/a").alias("file"), F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("session"), (F.col("user_id") % 5).alias("captured_at"), "sources", F.array(F.lit("orders"), F.concat(F.lit("t"), (F.col("user_id") % 4).cast("string"))).alias("tables")).write.json(path, compression="gzip")
    return observe.read_captures(spark, path)


_RANGE = "SELECT DISTINCT user_id, event_type AS file, (event_id % 300 + 1)::INTEGER AS start, (event_id % 300 + 10)::INTEGER AS stop FROM events"


@query(f"SELECT 't' || user_id AS test, 's' || user_id % 3 AS session, user_id % 5 AS captured_at, file, start, stop AS \"end\" FROM ({_RANGE})", on_graph=False)
def captured_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.captured_sources(_captures(spark, sf_dir)).select("test", "session", "captured_at", "file", "start", "end")


_OBSERVED = f"""WITH r AS ({_RANGE}), f AS (SELECT *, CASE WHEN file = (SELECT min(event_type) FROM events) THEN 'stale' WHEN file = (SELECT max(event_type) FROM events) THEN 'missing' ELSE 'verified' END AS freshness FROM r), sym AS (SELECT 'sym' || s_suppkey AS id, (SELECT min(event_type) FROM events WHERE event_type > (SELECT min(event_type) FROM events)) AS file, s_suppkey * 3 AS ss, s_suppkey * 3 + 4 AS se FROM supplier),
o AS (SELECT DISTINCT 'test:t' || user_id AS src, 'source_file:' || file AS dst, 'runtime_covers' AS type, freshness, 's' || user_id % 3 || '#t' || user_id AS observation FROM f UNION SELECT 'test:t' || user_id, sym.id, 'runtime_covers', freshness, 's' || user_id % 3 || '#t' || user_id FROM f JOIN sym ON f.file = sym.file AND start <= se AND stop >= ss
UNION SELECT 'test:t' || user_id, 'table:' || t, 'runtime_touches_table', 'unverified', 's' || user_id % 3 || '#t' || user_id FROM (SELECT DISTINCT user_id, unnest(['orders', 't' || user_id % 4]) AS t FROM events))"""


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [r[0] for r in read(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type").collect()]  # a handful
    manifest = spark.createDataFrame([(k, f"h{k}" if i else "other") for i, k in enumerate(kinds[:-1])], "path string, hash string")
    at = F.col("s_suppkey") * 3
    symbols = read(spark, sf_dir, "supplier").select(F.concat(F.lit("sym"), F.col("s_suppkey").cast("string")).alias("id"), F.lit(kinds[1]).alias("file"), at.cast("int").alias("start"), (at + 4).cast("int").alias("end"))
    return observe.observed_edges(_captures(spark, sf_dir), F.broadcast(manifest), symbols)


@query(f"{_OBSERVED} SELECT * FROM o", on_graph=False)
def observed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _observed(spark, sf_dir)


@query(f"{_OBSERVED} SELECT src, dst, type, count(*) FILTER (WHERE freshness = 'verified') AS verified, CASE WHEN count(*) FILTER (WHERE freshness = 'verified') > 0 THEN 1 ELSE 0.7 END::DOUBLE AS confidence FROM o GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE freshness IN ('verified', 'unverified')) > 0", on_graph=False)
def imported_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.import_edges(_observed(spark, sf_dir)).select("src", "dst", "type", "verified", "confidence")


@query("WITH x AS (SELECT DISTINCT user_id % 100 AS test, 'f' || event_id % 40 AS file FROM events) SELECT test, file FROM (SELECT *, row_number() OVER (PARTITION BY test ORDER BY file LIKE '%7' DESC, file) AS k FROM x) WHERE k <= 5", on_graph=False)
def capped_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read(spark, sf_dir, "events").select((F.col("user_id") % 100).alias("test"), F.concat(F.lit("f"), (F.col("event_id") % 40).cast("string")).alias("file")).distinct()
    return observe.capped(x.withColumn("is_template", F.col("file").endswith("7")), 5).select("test", "file")


@query("SELECT user_id % 50 AS test, event_type AS file, CASE WHEN count(DISTINCT event_id % 2) = 1 THEN 'h' || max(event_id % 2) END AS hash FROM events WHERE event_id % 7 < 2 GROUP BY 1, 2", on_graph=False)
def agreed_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").where("event_id % 7 < 2").select((F.col("user_id") % 50).alias("test"), F.col("event_type").alias("file"), F.concat(F.lit("h"), (F.col("event_id") % 2).cast("string")).alias("hash"))
    return rows.groupBy("test", "file").agg(observe.one_hash("hash").alias("hash"))


# verification ---------------------------------------------------------------------------------------------------------------


@query("SELECT id FROM nodes WHERE type IN ('table', 'column', 'model')")
def shared_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.shared_resources(graph(spark, sf_dir).nodes)


@query("SELECT id FROM nodes WHERE file IN ('app/F.src', 'app/O.src') ORDER BY id LIMIT 1000")
def nodes_for_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.nodes_for_files(graph(spark, sf_dir).nodes, spark.createDataFrame([("app/F.src",), ("app/O.src",), ("app/none",)], "path string"), 1000)


@query(f"{_GENERATIONS}, total AS (SELECT category, count(*) AS n FROM diff GROUP BY 1), turns AS (SELECT category, n, row_number() OVER (ORDER BY CASE category WHEN 'writes' THEN 2 WHEN 'routes' THEN 4 WHEN 'nodes' THEN 6 ELSE 7 END) AS i, count(*) OVER () AS m FROM total), r AS (SELECT d.*, row_number() OVER (PARTITION BY category ORDER BY entity, identity, CASE kind WHEN 'removed' THEN 0 WHEN 'changed' THEN 1 ELSE 2 END) AS rank FROM diff d), share AS (SELECT category, least(n, ceil(24.0 / m)) AS s FROM turns) SELECT category, entity, identity, kind, rank::INTEGER AS rank FROM r JOIN share USING (category) WHERE rank <= s")
def fair_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.fair_details(diff.changes(*generations(spark, sf_dir)), 24).select("category", "entity", "identity", "kind", "rank")


@query()
def target_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two generations have around the first method: the neighbourhoods of both; its SQL is that of neighbourhood, twice."""
    before, after = generations(spark, sf_dir)
    scope, _, exact = verify.target_scope(before, after, ["method:1"], 2)
    return scope.withColumn("exact", F.lit(exact))


@query(f"{_GENERATIONS} SELECT count(*) AS changes, 'graph_changes_observed' AS status FROM diff")
def verified_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = verify.verify(*generations(spark, sf_dir))
    return spark.createDataFrame([(found["changes"], found["status"])], "changes long, status string")


@query(f"{_GENERATIONS} SELECT category, kind, count(*) AS n, least(count(*), 25) AS shown FROM diff WHERE category IN ('routes', 'writes') GROUP BY 1, 2")
def risk_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of the categories at risk, by kind, and how many of them a list of 25 a kind shows."""
    changes = diff.changes(*generations(spark, sf_dir)).where("category IN ('routes', 'writes')")
    return changes.groupBy("category", "kind").agg(F.count("*").alias("n")).withColumn("shown", F.least("n", F.lit(25)).cast("long"))


@query(f"WITH {_MANIFESTS} SELECT status, count(*) AS n FROM c GROUP BY status", on_graph=False)
def file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.source_changes(*manifests(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


# the API --------------------------------------------------------------------------------------------------------------------


def _answer(spark: SparkSession, sf_dir: str, name: str, target: str | None, fields: str, part: str = "results", **options) -> DataFrame:
    """Rows of a named query's answer, which is one bounded document."""
    g = graph(spark, sf_dir)
    found = api.Engine(g.nodes, g.edges).query(name, target, **options)[part]
    names = [f.split()[0] for f in fields.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in found], fields)


@query(f"SELECT src AS caller, confidence::DOUBLE AS confidence, count(*) OVER () AS total FROM edges WHERE type = 'writes' AND dst = {_FIRST_TABLE} ORDER BY src LIMIT 50")
def api_writes_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(spark, sf_dir, "writes-to", first_table(spark, sf_dir), "caller string, confidence double, total long")


@query("SELECT n.id, c.columns, a.readers, a.writers FROM (SELECT id FROM nodes WHERE type = 'table' ORDER BY id LIMIT 10) n LEFT JOIN (SELECT src AS id, count(*) AS columns FROM edges WHERE type = 'has_column' GROUP BY src) c USING (id) LEFT JOIN (SELECT dst AS id, nullif(count(*) FILTER (WHERE type = 'reads'), 0) AS readers, nullif(count(*) FILTER (WHERE type = 'writes'), 0) AS writers FROM edges GROUP BY dst) a USING (id)")
def api_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(spark, sf_dir, "tables", None, "id string, columns long, readers long, writers long", limit=10)


@query(f"SELECT id, type, label FROM nodes WHERE id = {_FIRST_TABLE} UNION ALL SELECT id, type, label FROM nodes WHERE id <> {_FIRST_TABLE} AND (contains(lower(id), lower({_FIRST_TABLE})) OR contains(lower(label), lower({_FIRST_TABLE})) OR contains(lower(name), lower({_FIRST_TABLE}))) ORDER BY id LIMIT 50")
def api_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(spark, sf_dir, "find", first_table(spark, sf_dir), "id string, type string, label string")


@query("SELECT id, type FROM nodes WHERE type = 'event' AND contains(lower(label), (SELECT lower(min(s_name)) FROM supplier))")
def api_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(spark, sf_dir, "search", read(spark, sf_dir, "supplier").agg(F.min("s_name")).first()[0], "id string, type string")


@query(
    """, t AS (SELECT 'method:' || min(o_orderkey) AS t FROM orders), o AS (SELECT 'out' AS direction, type, dst AS endpoint FROM edges, t WHERE src = t ORDER BY type, dst LIMIT 50), i AS (SELECT 'in' AS direction, type, src AS endpoint FROM edges, t WHERE dst = t ORDER BY type, src LIMIT 50) SELECT * FROM o UNION ALL SELECT * FROM i"""
)
def api_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(spark, sf_dir, "node", f"method:{read(spark, sf_dir, 'orders').agg(F.min('o_orderkey')).first()[0]}", "direction string, type string, endpoint string")


@query("SELECT 'node' AS entity, type, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type")
def api_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    found = api.Engine(g.nodes, g.edges).query("overview")
    return spark.createDataFrame([(e, t, n) for e in ("node", "edge") for t, n in found[e].items()], "entity string, type string, n long")


@query("SELECT dst AS target, 1 AS depth, confidence::DOUBLE AS confidence FROM edges WHERE type = 'calls' AND src = (SELECT min(src) FROM edges WHERE type = 'calls')")
def api_calls_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = graph(spark, sf_dir).edges.where("type = 'calls'").agg(F.min("src")).first()[0]
    return _answer(spark, sf_dir, "calls-from", first, "node string, depth int, confidence double", depth=1).withColumnRenamed("node", "target")


@query(f"{_GENERATIONS} SELECT category, least(count(*), 1000) > 0 AS shown FROM diff GROUP BY 1")
def api_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rebuilds; the second's receipt has details of each category that changed."""
    import os

    s = store.Store(spark, own_folder(spark, "store"))
    lock = f"/tmp/latticework-{os.getpid()}.lock"
    hashes = ("content_hash", "semantic_hash")
    for nodes, edges in generations(spark, sf_dir):
        receipt = api.rebuild(s, nodes.drop(*hashes), edges.drop(*hashes), lock)
    assert receipt["generation"] == 2 and receipt["changes"] > 0
    return spark.createDataFrame([(c, bool(d)) for c, d in receipt["details"].items()], "category string, shown boolean")
