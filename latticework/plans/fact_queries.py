"""Queries over facts of parsed sources, here drawn from the relational tables, with SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.operators import verify
from latticework.plans.catalog import manifests, query
from latticework.sources import facts, files, schema_dump
from latticework.sources.bench_graph import read

_OPS = "['first', 'update', 'updateOrCreate', 'count', 'tap', 'firstOrCreate', 'save']"
_READS = "(" + ", ".join(repr(x) for x in facts.READ_OPERATIONS) + ")"
_WRITES = "(" + ", ".join(repr(x) for x in facts.WRITE_OPERATIONS) + ")"


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    ops = F.array(*[F.lit(x) for x in ("first", "update", "updateOrCreate", "count", "tap", "firstOrCreate", "save")])
    return item.select(F.concat(F.lit("method:"), F.col("l_orderkey").cast("string")).alias("method"), F.col("p_brand").alias("tbl"), F.get(ops, (F.col("l_suppkey") % 7).cast("int")).alias("operation"), F.col("l_linenumber").alias("line"), F.array("l_returnflag").alias("fields"), F.lit("complete").alias("coverage"), F.lit(0.95).alias("confidence"))


@query(
    f"""WITH c AS (SELECT 'method:' || l_orderkey AS src, 'table:' || p_brand AS dst, {_OPS}[l_suppkey % 7 + 1] AS op, l_linenumber AS line, l_returnflag AS f FROM lineitem JOIN part ON l_partkey = p_partkey),
e AS (SELECT *, 'reads' AS type FROM c WHERE op IN {_READS} UNION ALL SELECT *, 'writes' FROM c WHERE op IN {_WRITES})
SELECT src, dst, type, max(CASE WHEN op IN ('firstOrCreate', 'updateOrCreate') AND type = 'writes' THEN 0.62 WHEN op IN ('exists', 'count', 'pluck', 'value') THEN 0.9 ELSE 0.86 END)::DOUBLE AS confidence, string_agg(DISTINCT lpad(line::VARCHAR, 9, '0') || ':' || op || '=' || f, ',' ORDER BY lpad(line::VARCHAR, 9, '0') || ':' || op || '=' || f) AS operations FROM e GROUP BY src, dst, type""",
    on_graph=False,
)
def data_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.data_flow(_calls(spark, sf_dir)).withColumn("operations", F.array_join(F.transform("operations", lambda o: F.concat(o["key"], F.lit("="), F.array_join(o["fields"], "+"))), ","))


@query(
    """WITH c AS (SELECT 'method:' || o_orderkey AS src, ['cache', 'storage', 'http'][o_custkey % 3 + 1] AS root, ['get', 'put', 'remember', 'delete', 'flush'][o_orderkey % 5 + 1] AS op, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END AS target FROM orders),
e AS (SELECT src, CASE root WHEN 'cache' THEN 'cache' WHEN 'storage' THEN 'filesystem' ELSE 'external_service' END AS node, CASE WHEN root = 'cache' AND op = 'flush' THEN '*' ELSE target END AS target, unnest(CASE root WHEN 'cache' THEN CASE op WHEN 'get' THEN ['reads_cache'] WHEN 'remember' THEN ['reads_cache', 'writes_cache'] WHEN 'put' THEN ['writes_cache'] WHEN 'flush' THEN ['writes_cache'] ELSE [] END WHEN 'storage' THEN CASE op WHEN 'get' THEN ['reads_filesystem'] WHEN 'put' THEN ['writes_filesystem'] WHEN 'delete' THEN ['writes_filesystem'] ELSE [] END ELSE CASE WHEN op IN ('get', 'put', 'delete') THEN ['calls_external'] ELSE [] END END) AS type FROM c)
SELECT src, 'side-effect:' || node || ':default:' || coalesce(target, '{dynamic}') AS dst, type, max(CASE WHEN target IS NULL THEN 0.45 ELSE 0.95 END)::DOUBLE AS confidence FROM e GROUP BY 1, 2, 3""",
    on_graph=False,
)
def side_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    calls = read(spark, sf_dir, "orders").select(F.concat(F.lit("method:"), F.col("o_orderkey").cast("string")).alias("method"), pick(("cache", "storage", "http"), F.col("o_custkey") % 3).alias("root"), pick(("get", "put", "remember", "delete", "flush"), F.col("o_orderkey") % 5).alias("operation"), F.lit(None).cast("string").alias("scope"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("target"))
    return facts.side_effects(calls)


@query(
    """WITH c AS (SELECT 'method:' || l_orderkey AS src, 'event:' || l_suppkey % 5 AS dst, CASE WHEN l_returnflag = 'R' THEN 'broadcast' WHEN l_linestatus = 'O' THEN 'queued' ELSE 'sync' END AS mode, l_returnflag AS op, l_discount AS conf FROM lineitem)
SELECT src, dst, max(1 - conf)::DOUBLE AS confidence, string_agg(DISTINCT mode, ',' ORDER BY mode) AS modes, string_agg(DISTINCT op, ',' ORDER BY op) AS methods, CASE WHEN count(DISTINCT mode) = 1 THEN max(mode) ELSE 'mixed' END AS mode FROM c GROUP BY src, dst""",
    on_graph=False,
)
def dispatch_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("l_returnflag") == "R", "broadcast").when(F.col("l_linestatus") == "O", "queued").otherwise("sync")
    calls = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("method:"), F.col("l_orderkey").cast("string")).alias("method"), F.concat(F.lit("event:"), (F.col("l_suppkey") % 5).cast("string")).alias("target"), F.lit("job").alias("kind"), F.col("l_returnflag").alias("operation"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("offset"), mode.alias("mode"), (1 - F.col("l_discount")).alias("confidence"))
    return facts.dispatches(calls).drop("occurrences").withColumns({"modes": F.array_join("modes", ","), "methods": F.array_join("methods", ",")})


@query(
    "WITH c AS (SELECT l_orderkey AS src, list(l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS jobs, min(l_linestatus) = 'O' AS pub FROM lineitem GROUP BY 1), e AS (SELECT src, unnest(jobs) AS dst, generate_subscripts(jobs, 1) - 1 AS position, pub FROM c) SELECT src, dst, CAST(position AS INTEGER) AS position, CASE WHEN position = 0 AND pub THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence, CASE WHEN position = 0 AND pub THEN NULL ELSE false END AS causal FROM e",
    on_graph=False,
)
def job_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("method")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("x"), (F.min("l_linestatus") == "O").alias("public"))
    return facts.job_chain(rows.select("method", "public", F.col("x")["l_suppkey"].alias("jobs")))


_CLASSES = "cl AS (SELECT p_partkey AS class, CASE WHEN p_partkey > 3 THEN p_partkey // 4 END AS parent, -(p_size + 1) AS trait FROM part)"


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("class"), F.when(F.col("p_partkey") > 3, F.expr("p_partkey div 4")).alias("parent"), F.array((-(F.col("p_size") + 1)).cast("long")).alias("traits"))


@query(
    f"WITH RECURSIVE {_CLASSES}, up(class, ancestor, distance) AS (SELECT class, class, 0 FROM cl UNION ALL SELECT u.class, c.parent, u.distance + 2 FROM up u JOIN cl c ON u.ancestor = c.class WHERE c.parent IS NOT NULL AND u.distance < 16) SELECT class, ancestor, CAST(min(distance) AS INTEGER) AS distance FROM (SELECT * FROM up UNION ALL SELECT u.class, c.trait, u.distance + 1 FROM up u JOIN cl c ON u.ancestor = c.class) GROUP BY 1, 2",
    on_graph=False,
)
def class_ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.ancestry(_classes(spark, sf_dir))


@query(
    f"WITH RECURSIVE {_CLASSES}, up(class, ancestor, distance) AS (SELECT class, class, 0 FROM cl UNION ALL SELECT u.class, c.parent, u.distance + 2 FROM up u JOIN cl c ON u.ancestor = c.class WHERE c.parent IS NOT NULL AND u.distance < 16), d AS (SELECT p_partkey AS class, CASE WHEN p_partkey % 5 = 0 THEN 'getter_' || p_partkey END AS getter, CASE WHEN p_partkey % 3 = 0 THEN 'prop_' || p_partkey END AS property, p_partkey % 11 = 0 AS dyn, regexp_replace(p_brand, '#', 'Y') AS short FROM part), near AS (SELECT u.class, arg_min(struct_pack(getter, property, dyn), distance) AS b FROM up u JOIN d ON u.ancestor = d.class WHERE getter IS NOT NULL OR property IS NOT NULL OR dyn GROUP BY 1) SELECT d.class, CASE WHEN coalesce(b.dyn, false) AND b.getter IS NULL THEN NULL ELSE coalesce(b.getter, b.property, lower(regexp_replace(short, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) || 's') END AS tbl, CASE WHEN coalesce(b.dyn, false) AND b.getter IS NULL THEN 0.0 WHEN coalesce(b.getter, b.property) IS NOT NULL THEN 1.0 ELSE 0.85 END::DOUBLE AS confidence FROM d LEFT JOIN near USING (class)",
    on_graph=False,
)
def model_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    models = p.select(F.col("p_partkey").alias("class"), F.regexp_replace("p_brand", "#", "Y").alias("short"), F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("getter_"), key)).alias("getter"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("prop_"), key)).alias("property"), (F.col("p_partkey") % 11 == 0).alias("dynamic"))
    parents = facts.ancestry(_classes(spark, sf_dir).withColumn("traits", F.array().cast("array<bigint>")))
    return facts.model_tables(models, parents).drop("source")


@query(
    "WITH c AS (SELECT l_suppkey AS class, l_partkey % 3000 AS target, l_returnflag AS kind, 'm' || l_linenumber AS method FROM lineitem), k AS (SELECT DISTINCT p_partkey AS target FROM part) SELECT class AS src, CASE WHEN k.target IS NOT NULL THEN 'model:' || c.target ELSE 'unknown:relationship:' || class || '::' || method END AS dst, kind AS type, CASE WHEN max(k.target) IS NOT NULL THEN 0.75 ELSE 0.45 END::DOUBLE AS confidence, string_agg(DISTINCT method, ',' ORDER BY method) AS methods FROM c LEFT JOIN k ON c.target = k.target GROUP BY 1, 2, 3",
    on_graph=False,
)
def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("class"), F.concat(F.lit("model:"), (F.col("l_partkey") % 3000).cast("string")).alias("target"), F.col("l_returnflag").alias("kind"), F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("method"))
    known = read(spark, sf_dir, "part").select(F.concat(F.lit("model:"), F.col("p_partkey").cast("string")).alias("class")).distinct()
    return facts.relationships(calls, known).withColumn("methods", F.array_join("methods", ","))


_SHORT = "'S' || CASE WHEN p_partkey % 3 = 2 THEN p_partkey - 1 ELSE p_partkey END"


@query(
    f"WITH m AS (SELECT {_SHORT} AS short, min(p_partkey) AS model FROM part GROUP BY 1 HAVING count(*) = 1), c AS (SELECT s_suppkey AS policy, 'S' || s_suppkey % 60 AS short FROM supplier) SELECT model, min(policy) AS policy FROM c JOIN m USING (short) GROUP BY model",
    on_graph=False,
)
def convention_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.concat(F.lit("S"), (F.col("p_partkey") - (F.col("p_partkey") % 3 == 2).cast("long")).cast("string"))
    classes = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("class"), F.concat(F.lit("S"), (F.col("s_suppkey") % 60).cast("string"), F.lit("Policy")).alias("short"))
    return facts.convention_policies(classes, read(spark, sf_dir, "part").select(F.col("p_partkey").alias("class"), short.alias("short")))


@query(
    "WITH RECURSIVE b AS (SELECT p_partkey AS a, p_partkey // 3 AS n, CASE WHEN p_partkey % 2 = 0 THEN 0.9 ELSE 0.75 END::DOUBLE AS c FROM part WHERE p_partkey > 400), s(a, n, c, d) AS (SELECT a, n, round(c, 2), 1 FROM b UNION ALL SELECT s.a, b.n, round(s.c * b.c, 2), d + 1 FROM s JOIN b ON s.n = b.a WHERE d < 6) SELECT a AS abstract, n AS concrete, max(c) AS confidence FROM s WHERE n NOT IN (SELECT a FROM b) GROUP BY 1, 2",
    on_graph=False,
)
def effective_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "part").where("p_partkey > 400").select(F.col("p_partkey").alias("abstract"), F.expr("p_partkey div 3").alias("concrete"), F.when(F.col("p_partkey") % 2 == 0, 0.9).otherwise(0.75).alias("confidence"))
    return facts.effective_bindings(b)


@query(
    "WITH r AS (SELECT c_custkey, unnest(CASE WHEN c_custkey % 2 = 0 THEN ['GET', 'HEAD'] ELSE ['POST'] END) AS verb, CASE WHEN c_custkey % 7 = 0 THEN '//' || lower(c_mktsegment) || '.example/' ELSE '' END || 'c/' || c_custkey AS uri FROM customer) SELECT 'route:' || verb || ':' || uri AS src, CASE t WHEN 0 THEN 'C::a' || c_custkey ELSE ['auth', 'web', 'auth'][t] END AS dst, CASE t WHEN 0 THEN 'routes_to' ELSE 'passes_through' END AS type, CAST(CASE WHEN t = 0 THEN 0.86 ELSE 1 END AS DOUBLE) AS confidence, CAST(CASE WHEN t = 0 THEN 0 WHEN t = 1 THEN 2 ELSE 1 END AS INTEGER) AS places FROM r, (VALUES (0), (1), (2)) v(t)",
    on_graph=False,
)
def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    raw = read(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("GET"), F.lit("HEAD"))).otherwise(F.array(F.lit("POST"))).alias("methods"), F.concat(F.lit("/c/"), key).alias("uri"), F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lower("c_mktsegment"), F.lit(".example"))).alias("domain"), F.col("c_name").alias("name"), F.concat(F.lit("C::a"), key).alias("action"), F.lit(0.95).alias("confidence"), F.lit(0.9).alias("binding"), F.array(F.lit("auth"), F.lit("web"), F.lit("auth")).alias("middleware"))
    return facts.routes(raw)[1].withColumn("places", F.size("places"))


@query(
    "WITH c AS (SELECT o_orderkey AS call, 'GET' AS method, '/orders/' || CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderkey::VARCHAR END AS path, CASE o_orderkey % 4 WHEN 0 THEN 'a.example' WHEN 1 THEN 'b.example' END AS host FROM orders), r(route, pattern, domain) AS (VALUES ('any', '^/?orders/[^/]+/?$', NULL), ('new', '^/?orders/new/?$', NULL), ('sub', '^/?orders/[^/]+/?$', 'a.example')), j AS (SELECT call, route, host, domain, count(*) OVER (PARTITION BY call) AS candidates, bool_or(host IS NULL AND domain IS NOT NULL) OVER (PARTITION BY call) AS bound FROM c JOIN r ON regexp_matches(path, pattern) AND (host IS NULL OR domain IS NULL OR host = domain)) SELECT call, route, CASE WHEN candidates > 1 OR bound THEN 'possible' ELSE 'exact' END AS certainty, candidates, CASE WHEN candidates > 1 OR bound THEN 0.55 ELSE 0.9 END::DOUBLE AS confidence FROM j",
    on_graph=False,
)
def literal_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/orders/"), F.when(F.col("o_orderkey") % 3 == 0, "new").otherwise(F.col("o_orderkey").cast("string")))
    host = F.when(F.col("o_orderkey") % 4 == 0, "https://a.example").when(F.col("o_orderkey") % 4 == 1, "http://b.example:80").otherwise("")
    calls = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call"), F.lit("GET").alias("method"), F.concat(host, path).alias("url"))
    known = spark.createDataFrame([("any", "GET", "orders/{id}", None), ("new", "GET", "orders/new", None), ("sub", "GET", "/orders/{id}", "a.example"), ("post", "POST", "orders/{id}", None)], "route string, method string, uri string, domain string")
    return files.literal_matches(calls, known)


@query(
    "WITH b AS (SELECT doc_id AS path, sha256(text) AS hash FROM documents WHERE doc_id % 13 <> 0), a AS (SELECT doc_id AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 11 <> 0), r AS (SELECT DISTINCT user_id AS path FROM events) SELECT CAST(r.path AS VARCHAR) AS path, CASE WHEN b.hash IS NULL AND a.hash IS NULL THEN 'not_recorded' WHEN b.hash IS NULL THEN 'added' WHEN a.hash IS NULL THEN 'removed' WHEN a.hash = b.hash THEN 'unchanged' ELSE 'changed' END AS status FROM r LEFT JOIN b USING (path) LEFT JOIN a USING (path)",
    on_graph=False,
)
def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    requested = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"))
    return verify.source_coverage(*manifests(spark, sf_dir), requested)


@query("SELECT 'table:t' || n_nationkey AS src, 'column:t' || n_nationkey || '.' || c AS dst, 'has_column' AS type FROM nation, (VALUES ('id'), ('name'), ('r' )) v(c) UNION ALL SELECT 'table:t' || n_nationkey, 'index:t' || n_nationkey || '.' || i, 'has_index' FROM nation, (VALUES ('primary'), ('by_name')) v(i) UNION ALL SELECT 'table:t' || n_nationkey, 'foreign_key:t' || n_nationkey || '.fk' || n_regionkey, 'has_foreign_key' FROM nation", on_graph=False)
def schema_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, region = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    sql = F.concat(F.lit("-- a; comment\nCREATE TABLE `t"), key, F.lit("` (\n  `id` bigint unsigned NOT NULL AUTO_INCREMENT,\n  `name` varchar(25) DEFAULT 'x;''y', /* c */\n  r int NOT NULL COMMENT 'a, b',\n  PRIMARY KEY (`id`),\n  CONSTRAINT fk"), region, F.lit(" FOREIGN KEY (r) REFERENCES region (id) ON DELETE CASCADE\n);\nCREATE UNIQUE INDEX by_name ON t"), key, F.lit(" (name);"))
    dumps = read(spark, sf_dir, "nation").select(key.alias("source"), sql.alias("sql"))
    return schema_dump.graph(schema_dump.parsed(dumps))[1]


_DUMP = r"""SELECT 't' || n_nationkey AS tbl, 'a' AS name, 'varchar(' || n_nationkey + 1 || ')' AS type, true AS nullable, 'it\''s, (' || n_regionkey AS "default", false AS auto_increment, NULL AS comment FROM nation UNION ALL SELECT 't' || n_nationkey, 'b', 'int', n_nationkey % 2 = 0, NULL, n_nationkey % 2 = 1, 'o''k, ' || n_regionkey FROM nation UNION ALL SELECT 't' || n_nationkey, 'c', 'int', true, '(x #> y)', false, NULL FROM nation"""


@query(_DUMP, on_graph=False)
def schema_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of the columns of dumps with escapes, brackets and number signs inside of values."""
    key, region = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    odd = F.when(F.col("n_nationkey") % 2 == 1, " NOT NULL AUTO_INCREMENT").otherwise("")
    sql = F.concat(F.lit("/* t; */ CREATE TABLE t"), key, F.lit(" (a varchar("), (F.col("n_nationkey") + 1).cast("string"), F.lit(") DEFAULT 'it\\'s, ("), region, F.lit("', b int"), odd, F.lit(" COMMENT 'o\\'k, "), region, F.lit("', c int DEFAULT (x #> y));"))
    tables = schema_dump.parsed(read(spark, sf_dir, "nation").select(key.alias("source"), sql.alias("sql")))
    return tables.select(F.col("name").alias("tbl"), F.explode("columns").alias("c")).select("tbl", "c.*")
