"""Queries over facts of routes, events, requests, accesses and running applications, drawn from the relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions import text
from latticework.plans.catalog import query
from latticework.sources import accesses, events, facts, files, live, requests, routing
from latticework.sources.bench_graph import read


def name(prefix: str, column: Column | str, suffix: str = "") -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.concat(F.lit(prefix), column.cast("string"), F.lit(suffix))


def pick(values: tuple, at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


def rows(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


def joined(column: str, sep: str = ",") -> Column:
    return F.array_join(column, sep)


# events -------------------------------------------------------------------------------------------------------------------

_CLASS = r"['App\Events\P', 'App\Jobs\P', 'App\Other\P', 'App\Models\P'][p_partkey % 4 + 1] || p_partkey"


@query(
    rf"""WITH c AS (SELECT {_CLASS} AS class, ['app/Events/x.src', 'app/Jobs/x.src', 'app/x.src'][p_size % 3 + 1] AS file, p_size % 5 AS t FROM part WHERE p_partkey % 7 <> 0)
SELECT class, CASE WHEN contains('\' || class, '\Events\') OR starts_with(file, 'app/Events/') OR t = 0 THEN 'event' ELSE 'job' END AS role FROM c WHERE contains('\' || class, '\Events\') OR starts_with(file, 'app/Events/') OR t <= 1 OR contains('\' || class, '\Jobs\') OR starts_with(file, 'app/Jobs/')""",
    on_graph=False,
)
def class_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    own = F.concat(pick(("App\\Events\\P", "App\\Jobs\\P", "App\\Other\\P", "App\\Models\\P"), F.col("p_partkey") % 4), F.col("p_partkey").cast("string"))
    classes = p.select(own.alias("class"), pick(("app/Events/x.src", "app/Jobs/x.src", "app/x.src"), F.col("p_size") % 3).alias("file"), F.when(F.col("p_partkey") % 7 == 0, "trait").otherwise("class").alias("kind"))
    above = p.where("p_size % 5 < 2").select(own.alias("class"), pick((events.EVENT_TRAIT, events.JOB_TRAIT), F.col("p_size") % 5).alias("ancestor"))
    return events.class_roles(classes, above)


@query(
    """WITH c AS (SELECT 'L' || p_partkey AS class, p_partkey AS k FROM part WHERE p_partkey % 3 = 0), m AS (SELECT class, k, unnest(['handle', 'handleOther', '__invoke', 'other']) AS method FROM c WHERE k % 5 <> 0 AND k % 11 <> 0)
SELECT class AS listener, method, 'E' || k % 10 AS event, 0.85::DOUBLE AS confidence FROM m WHERE method <> 'other' AND (k + length(method)) % 2 = 0 AND k % 10 < 5 UNION ALL SELECT class, NULL, 'listener_not_instantiable', NULL FROM c WHERE k % 5 = 0 OR k % 11 = 0""",
    on_graph=False,
)
def discovered_listeners(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), name("L", "p_partkey").alias("class"))
    classes = p.select("class", F.concat(F.when(F.col("k") % 3 == 0, "app/Listeners/").otherwise("app/"), "class").alias("file"), F.when(F.col("k") % 5 == 0, "trait").otherwise("class").alias("kind"), (F.col("k") % 11 == 0).alias("abstract"))
    methods = p.select("class", "k", F.explode(F.array(*map(F.lit, ("handle", "handleOther", "__invoke", "other")))).alias("method")).select("class", "method", F.when((F.col("k") + F.length("method")) % 2 == 0, "public").otherwise("protected").alias("visibility"), name("E", F.col("k") % 10).alias("first_type"))
    roles = rows(spark, [(f"E{i}", "event" if i < 5 else "job") for i in range(10)], "class string, role string")
    found, warned = events.discovered_listeners(classes, methods, roles)
    return found.unionByName(warned.select("listener", F.lit(None).cast("string").alias("method"), F.col("reason").alias("event"), F.lit(None).cast("double").alias("confidence")))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'always' WHEN 1 THEN CASE WHEN o_custkey % 3 = 0 THEN 'invalid' WHEN o_orderkey % 3 = 1 AND o_custkey % 5 = 0 THEN 'always' WHEN o_orderkey % 3 = 1 AND o_custkey % 5 = 1 THEN 'never' ELSE 'conditional' END ELSE 'unproven' END AS decision FROM orders""",
    on_graph=False,
)
def queue_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    decision = events.queue_decision(pick(("absent", "found", "ambiguous", None), F.col("o_orderkey") % 4), F.when(F.col("o_custkey") % 3 != 0, "public"), F.col("o_orderkey") % 3, pick(("True", "FALSE", "PHP_EOL", None, None), F.col("o_custkey") % 5))
    return read(spark, sf_dir, "orders").select("o_orderkey", decision.alias("decision"))


@query(
    """WITH c AS (SELECT 'm' || o_orderkey AS src, o_orderkey AS line, ['Event', 'Bus', 'J1', 'M1', 'K1'][o_orderkey % 5 + 1] AS class, ['dispatch', 'listen', 'observe', 'dispatchSync', 'other'][o_custkey % 5 + 1] AS op, CASE WHEN o_orderkey % 3 > 0 THEN 'T' || o_orderkey % 7 END AS target FROM orders),
e AS (SELECT src, target AS dst, 'dispatches' AS type, 'event' AS kind, line FROM c WHERE class = 'Event' AND op = 'dispatch' UNION ALL SELECT src, target, 'listens_to', 'event', line FROM c WHERE class = 'Event' AND op = 'listen' UNION ALL SELECT src, target, 'dispatches', 'job', line FROM c WHERE class = 'Bus' AND op IN ('dispatch', 'dispatchSync')
  UNION ALL SELECT target, class, 'observes', 'observer', line FROM c WHERE class = 'M1' AND op = 'observe' UNION ALL SELECT src, class, 'dispatches', 'job', line FROM c WHERE class = 'J1' AND op IN ('dispatch', 'dispatchSync'))
SELECT src, dst, type, kind, 0.9::DOUBLE AS confidence, line FROM e WHERE src IS NOT NULL AND dst IS NOT NULL UNION ALL SELECT src, class, 'static_dispatch_method_unproven', op, NULL, NULL FROM c WHERE class = 'K1' AND op IN ('dispatch', 'dispatchSync')""",
    on_graph=False,
)
def static_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = read(spark, sf_dir, "orders").select(name("m", "o_orderkey").alias("method"), pick(("Event", "Bus", "J1", "M1", "K1"), F.col("o_orderkey") % 5).alias("class"), pick(("dispatch", "listen", "observe", "dispatchSync", "other"), F.col("o_custkey") % 5).alias("operation"), F.when(F.col("o_orderkey") % 3 > 0, name("T", F.col("o_orderkey") % 7)).alias("target"), F.col("o_orderkey").alias("line"))
    edges, warned = events.static_calls(calls, rows(spark, [("J1", "job"), ("K1", "event")], "class string, role string"), rows(spark, [("M1",)], "class string"), rows(spark, [("J1", "job")], "class string, role string"))
    return edges.unionByName(warned.select("src", F.col("class").alias("dst"), F.col("reason").alias("type"), F.col("operation").alias("kind"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("long").alias("line")))


@query("SELECT 'O' || l_suppkey % 9 AS src, 'M' || l_partkey % 50 AS dst, 'observes' AS type, max(CASE l_returnflag WHEN 'R' THEN 0.9 ELSE 0.85 END)::DOUBLE AS confidence, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS sources FROM lineitem GROUP BY 1, 2", on_graph=False)
def observers(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = read(spark, sf_dir, "lineitem")
    return events.observes(item.select(name("O", F.col("l_suppkey") % 9).alias("observer"), name("M", F.col("l_partkey") % 50).alias("model"), F.when(F.col("l_returnflag") == "R", 0.9).otherwise(0.85).alias("confidence"), F.col("l_linestatus").alias("source"))).withColumn("sources", joined("sources"))


@query(
    """SELECT 'C' || o_custkey % 20 AS class, o_orderkey AS scope, 'x' || o_orderkey % 4 AS variable, CASE WHEN o_orderkey % 6 = 0 THEN 'T' ELSE 'C' || o_custkey % 20 END AS type, CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0.8 END::DOUBLE AS confidence FROM orders WHERE o_custkey % 20 = o_orderkey % 20 AND o_orderkey % 5 < 3 AND o_orderkey % 9 > 0""",
    on_graph=False,
)
def model_event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    parameter = F.struct(name("x", k % 4).alias("name"), F.when(k % 6 == 0, "T").alias("type"))
    closures = read(spark, sf_dir, "orders").select(name("C", F.col("o_custkey") % 20).alias("class"), k.alias("scope"), name("C", k % 20).alias("target"), pick(("creating", "saved", "restored", "retrieved", "boot"), k % 5).alias("operation"), F.when(k % 9 > 0, F.array(parameter, F.struct(F.lit("y").alias("name"), F.lit("Z").alias("type")))).otherwise(F.array().cast("array<struct<name:string,type:string>>")).alias("parameters"))
    return events.model_event_types(closures)


@query(
    r"""WITH RECURSIVE c AS (SELECT p_partkey AS k, CASE WHEN p_partkey IN (2, 3) THEN 'Illuminate\C' ELSE 'App\C' END || p_partkey AS class, p_partkey // 4 AS parent, p_size FROM part), up(k, a, d) AS (SELECT k, k, 0 FROM c UNION ALL SELECT u.k, x.parent, d + 2 FROM up u JOIN c x ON u.a = x.k WHERE x.parent > 0 AND d < 16),
every AS (SELECT u.k, x.class AS ancestor, d FROM up u JOIN c x ON u.a = x.k UNION ALL SELECT u.k, 'Laravel\T' || x.p_size, d + 1 FROM up u JOIN c x ON u.a = x.k WHERE x.p_size % 4 = 0)
SELECT c.class, arg_min(ancestor, d * 1000 + length(ancestor)) AS boundary FROM every JOIN c USING (k) WHERE starts_with(ancestor, 'Illuminate\') OR starts_with(ancestor, 'Laravel\') GROUP BY 1""",
    on_graph=False,
)
def framework_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    label = lambda c: F.concat(F.when(c.isin(2, 3), "Illuminate\\C").otherwise("App\\C"), c.cast("string"))
    parent = F.expr("p_partkey div 4")
    classes = p.select(label(F.col("p_partkey")).alias("class"), F.when(parent > 0, label(parent)).alias("parent"), F.when(F.col("p_size") % 4 == 0, F.array(name("Laravel\\T", "p_size"))).otherwise(F.array().cast("array<string>")).alias("traits"))
    return events.framework_boundary(facts.ancestry(classes))


@query(
    "WITH r AS (SELECT s_suppkey AS listener, l_orderkey % 30 AS event, max(CASE WHEN l_returnflag = 'R' THEN 0.85 ELSE 0.9 END) AS c, bool_or(l_linestatus = 'O') AS proven FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2) SELECT 'L' || listener AS src, 'E' || event AS dst, 'listens_to' AS type, round(c * 0.95, 2)::DOUBLE AS confidence FROM r UNION ALL SELECT 'E' || event, 'L' || listener || '::handle', 'handled_by', round(c * 0.95, 2)::DOUBLE FROM r WHERE proven",
    on_graph=False,
)
def listener_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "lineitem").groupBy(name("L", "l_suppkey").alias("listener"), name("E", F.col("l_orderkey") % 30).alias("event")).agg(F.max(F.when(F.col("l_returnflag") == "R", 0.85).otherwise(0.9)).alias("confidence"), F.max(F.col("l_linestatus") == "O").alias("proven"))
    listens, handled = facts.listeners(r.select("listener", F.lit("handle").alias("method"), "event", "confidence", F.lit(0.95).alias("binding"), "proven"))
    return listens.unionByName(handled)


@query(
    "WITH f AS (SELECT 'J' || p_partkey % 60 AS job, min(CASE WHEN p_size % 3 = 0 THEN 'H' || p_size END) AS handler FROM part GROUP BY 1), c AS (SELECT 'J' || s_suppkey AS job FROM supplier), j AS (SELECT job FROM f UNION SELECT job FROM c) SELECT job AS src, coalesce(handler, job) || '::handle' AS dst, 'handled_by' AS type, CASE WHEN handler IS NULL THEN 0.95 ELSE 0.86 END::DOUBLE AS confidence FROM j LEFT JOIN f USING (job)",
    on_graph=False,
)
def job_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "part").select(name("J", F.col("p_partkey") % 60).alias("job"), F.when(F.col("p_size") % 3 == 0, name("H", "p_size")).alias("handler"), F.lit(0.9).alias("binding"))
    return facts.handlers(found, read(spark, sf_dir, "supplier").select(name("J", "s_suppkey").alias("job")))


_CALLS = "calls AS (SELECT 'm' || o_orderkey AS caller, o_custkey % 40 + 1 AS class, ['run', 'active', 'stop', 'lost'][o_orderkey % 4 + 1] AS method, CASE WHEN o_orderkey % 2 = 0 THEN 0.95 ELSE 0.9 END::DOUBLE AS c FROM orders)"
_METHODS = "methods AS (SELECT p_partkey AS class, unnest(CASE p_partkey % 5 WHEN 0 THEN ['run', 'scopeActive'] WHEN 1 THEN ['stop'] WHEN 2 THEN ['run'] ELSE [] END) AS method FROM part WHERE p_partkey <= 40)"
_UP = "up(class, a, d) AS (SELECT p_partkey, p_partkey, 0 FROM part WHERE p_partkey <= 40 UNION ALL SELECT class, a // 4, d + 2 FROM up WHERE a // 4 > 0 AND d < 16)"
_RESOLVED = f"""WITH RECURSIVE {_UP}, {_CALLS}, {_METHODS}, k AS (SELECT class, method, method AS real, 1::DOUBLE AS w, 0 AS kind FROM methods UNION ALL SELECT class, 'active', method, 0.75::DOUBLE, 1 FROM methods WHERE method = 'scopeActive'),
t AS (SELECT DISTINCT caller, c.class, c.method, c.c, up.a, k.real, k.w, row_number() OVER (PARTITION BY caller, c.class, c.method, c.c ORDER BY d, kind, a) AS n FROM calls c JOIN up ON c.class = up.class JOIN k ON k.class = up.a AND k.method = c.method)"""


def _resolved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    calls = read(spark, sf_dir, "orders").select(name("m", "o_orderkey").alias("caller"), (F.col("o_custkey") % 40 + 1).alias("class"), pick(("run", "active", "stop", "lost"), F.col("o_orderkey") % 4).alias("method"), F.when(F.col("o_orderkey") % 2 == 0, 0.95).otherwise(0.9).alias("confidence"))
    small = read(spark, sf_dir, "part").where("p_partkey <= 40")
    of = F.when(F.col("p_partkey") % 5 == 0, F.array(F.lit("run"), F.lit("scopeActive"))).when(F.col("p_partkey") % 5 == 1, F.array(F.lit("stop"))).when(F.col("p_partkey") % 5 == 2, F.array(F.lit("run"))).otherwise(F.array().cast("array<string>"))
    parent = F.expr("p_partkey div 4")
    above = facts.ancestry(small.select(F.col("p_partkey").alias("class"), F.when(parent > 0, parent).alias("parent"), F.array().cast("array<bigint>").alias("traits")))
    return facts.resolve_methods(calls, small.select(F.col("p_partkey").alias("class"), F.explode(of).alias("method")), above)


@query(f"{_RESOLVED} SELECT caller AS src, a || '::' || real AS dst, max(round(c * w, 2))::DOUBLE AS confidence FROM t WHERE n = 1 GROUP BY 1, 2", on_graph=False)
def resolved_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir)[0]


@query(f"{_RESOLVED} SELECT caller, 'unresolved_method' AS reason, count(*) AS n, string_agg(method, ',' ORDER BY method) AS first FROM calls c WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.caller = c.caller AND t.class = c.class AND t.method = c.method) GROUP BY 1, 2", on_graph=False)
def call_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.diagnostics(_resolved(spark, sf_dir)[1]).withColumn("first", joined("first"))


# routes -------------------------------------------------------------------------------------------------------------------


@query(
    "WITH b AS (SELECT 's' || s_suppkey AS a, CASE WHEN s_suppkey % 3 > 0 THEN 'c' || s_suppkey END AS concrete FROM supplier), a AS (SELECT c_custkey AS route, 's' || c_custkey % 200 AS class FROM customer) SELECT route, coalesce(concrete, class) AS class, class AS requested, CASE WHEN b.a IS NULL THEN 1 ELSE 0.9 END::DOUBLE AS confidence FROM a LEFT JOIN b ON a.class = b.a WHERE b.a IS NULL OR concrete IS NOT NULL UNION ALL SELECT route, 'controller_container_target_unknown', class, NULL FROM a JOIN b ON a.class = b.a WHERE concrete IS NULL",
    on_graph=False,
)
def controller_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("route"), name("s", F.col("c_custkey") % 200).alias("class"), F.lit("index").alias("method"))
    bindings = read(spark, sf_dir, "supplier").select(name("s", "s_suppkey").alias("abstract"), F.when(F.col("s_suppkey") % 3 > 0, name("c", "s_suppkey")).alias("concrete"), F.lit(0.9).alias("confidence"))
    found, warned = routing.controller_actions(actions, bindings)
    return found.drop("method").unionByName(warned.select("route", F.col("reason").alias("class"), "requested", F.lit(None).cast("double").alias("confidence")))


@query(
    """WITH p AS (SELECT 'm' || o_orderkey AS src, 'p' || o_orderkey % 3 AS parameter, o_custkey % 60 AS k FROM orders), j AS (SELECT p.*, 'K' || k AS class, k % 3 = 0 AS request, k % 4 = 0 AS model, k % 5 = 0 AS bound, CASE WHEN k % 10 = 0 THEN k + 3 ELSE k + 1 END AS t, k % 20 = 0 AS missing, k % 15 = 0 AS inst FROM p),
r AS (SELECT *, CASE WHEN bound AND missing THEN 'form_request_container_target_unknown' WHEN bound AND NOT (t < 60 AND t % 3 = 0 AND t % 7 > 0) THEN 'form_request_container_target_not_concrete' WHEN bound AND inst THEN 'form_request_existing_instance_bypasses_lifecycle' END AS reason FROM j)
SELECT src, CASE WHEN bound THEN 'K' || t ELSE class END AS dst, 'validates_with' AS type, CASE WHEN bound THEN 0.9 ELSE 1 END::DOUBLE AS confidence, parameter, parameter = 'p1' AS shared FROM r WHERE request AND reason IS NULL UNION ALL SELECT src, class, 'uses_model', 0.9, parameter, false FROM r WHERE model UNION ALL SELECT src, class, reason, NULL, parameter, NULL FROM r WHERE request AND reason IS NOT NULL""",
    on_graph=False,
)
def parameter_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    parameters = read(spark, sf_dir, "orders").select(name("m", "o_orderkey").alias("method"), name("p", F.col("o_orderkey") % 3).alias("parameter"), name("K", F.col("o_custkey") % 60).alias("class"), F.array(F.lit("p1"), F.lit("q")).alias("route_parameters"))
    k = F.col("id")
    classes = spark.range(60).select(name("K", "id").alias("class"), (k % 3 == 0).alias("request"), (k % 4 == 0).alias("model"), (k % 7 > 0).alias("concrete"))
    bindings = spark.range(60).where("id % 5 = 0").select(name("K", "id").alias("abstract"), F.when(k % 20 > 0, name("K", F.when(k % 10 == 0, k + 3).otherwise(k + 1))).alias("concrete"), F.lit(0.9).alias("confidence"), (k % 15 == 0).alias("instance"))
    edges, warned = routing.parameter_edges(parameters, classes, bindings)
    warned = warned.join(parameters.select(F.col("method").alias("src"), "parameter"), "src")
    return edges.unionByName(warned.select("src", F.col("requested").alias("dst"), F.col("reason").alias("type"), F.lit(None).cast("double").alias("confidence"), "parameter", F.lit(None).cast("boolean").alias("shared")))


_MIDDLEWARE = """WITH d AS (SELECT c_custkey AS route, u.p AS position, CASE WHEN u.p = 1 AND c_custkey % 2 = 0 THEN 'web' WHEN u.p = 2 THEN 'throttle:' || c_custkey % 3 WHEN u.p = 3 THEN 'm' || c_custkey % 7 ELSE 'm' || (c_custkey + u.p) % 5 END AS value FROM customer, (VALUES (0), (1), (2), (3), (4)) u(p)),
g(name, position, member) AS (VALUES ('web', 0, 'session'), ('web', 1, 'inner'), ('web', 2, 'm3'), ('inner', 0, 'csrf'), ('inner', 1, 'm1')), al(alias, class) AS (VALUES ('throttle', 'Throttle'), ('csrf', 'Csrf'), ('session', 'Session')),
x1 AS (SELECT route, d.position * 10000 + coalesce(g.position, 0) * 100 AS place, coalesce(member, value) AS value, value AS declared FROM d LEFT JOIN g ON d.value = g.name),
x2 AS (SELECT route, place + coalesce(g.position, 0) AS place, coalesce(member, value) AS value, declared FROM x1 LEFT JOIN g ON x1.value = g.name),
x AS (SELECT route, place, coalesce(class || substr(value, length(alias) + 1), value) AS value, declared FROM x2 LEFT JOIN al ON split_part(value, ':', 1) = alias)"""


def _middleware(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, p = F.col("c_custkey"), F.col("position")
    each = read(spark, sf_dir, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("position"))
    value = F.when((p == 1) & (k % 2 == 0), "web").when(p == 2, name("throttle:", k % 3)).when(p == 3, name("m", k % 7)).otherwise(name("m", (k + p) % 5))
    groups = rows(spark, [("web", 0, "session"), ("web", 1, "inner"), ("web", 2, "m3"), ("inner", 0, "csrf"), ("inner", 1, "m1")], "name string, position int, member string")
    aliases = rows(spark, [("throttle", "Throttle"), ("csrf", "Csrf"), ("session", "Session")], "alias string, class string")
    return routing.expanded_middleware(each.select(k.alias("route"), "position", value.alias("value")), groups, aliases)


_EFFECTIVE = f"""{_MIDDLEWARE}, kept AS (SELECT * FROM x WHERE NOT (route % 4 = 0 AND value = 'm2') AND NOT (route % 6 = 0 AND value IN ('Csrf', 'm1'))), pr(class, rank) AS (VALUES ('Session', 0), ('Csrf', 1), ('Throttle', 2), ('m4', 3), ('m0', 4)),
r AS (SELECT kept.*, rank FROM kept LEFT JOIN pr ON split_part(value, ':', 1) = class), s AS (SELECT *, coalesce(rank, max(rank) OVER (PARTITION BY route ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS key FROM r), f AS (SELECT *, row_number() OVER (PARTITION BY route, value ORDER BY key, place) AS n FROM s)"""


def _effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("route"))
    excluded = routes.where("route % 4 = 0").withColumn("value", F.lit("m2")).unionByName(routes.where("route % 6 = 0").withColumn("value", F.lit("Base")))
    parents = rows(spark, [("Csrf", "Base"), ("m1", "Base"), ("Csrf", "Csrf")], "class string, ancestor string")
    priority = rows(spark, [("Session", 0), ("Csrf", 1), ("Throttle", 2), ("m4", 3), ("m0", 4)], "class string, rank int")
    return routing.effective_middleware(_middleware(spark, sf_dir), excluded, parents, priority)


@query(f"{_EFFECTIVE} SELECT route, CAST(row_number() OVER (PARTITION BY route ORDER BY key, place) - 1 AS INTEGER) AS position, value, declared FROM f WHERE n = 1", on_graph=False)
def effective_middleware(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _effective(spark, sf_dir)


@query(f"{_EFFECTIVE}, q AS (SELECT route, row_number() OVER (PARTITION BY route ORDER BY key, place) - 1 AS position, value FROM f WHERE n = 1), c AS (SELECT *, row_number() OVER (PARTITION BY route, value ORDER BY place) AS n FROM x WHERE place >= 10000) SELECT q.route, CAST(q.position AS INTEGER) AS position, q.value, c.declared FROM q LEFT JOIN c ON q.route = c.route AND q.value = c.value AND c.n = 1", on_graph=False)
def middleware_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = _middleware(spark, sf_dir).where(F.get("place", F.lit(0)) > 0)
    return routing.middleware_provenance(_effective(spark, sf_dir), candidates)[0]


_REGISTERED = """WITH r AS (SELECT 'r' || c_custkey AS route, ['GET', 'POST'][c_custkey % 2 + 1] AS m, '/' || ['api', 'web', 'admin'][c_custkey % 3 + 1] || '/c' || c_custkey % 400 || '/edit' AS u, ['Closure', 'ViewController'][c_custkey // 7 % 2 + 1] AS a FROM customer),
g AS (SELECT o_orderkey AS registration, o_custkey % 4 > 0 AS known, CASE WHEN o_orderkey % 3 > 0 THEN ['GET', 'POST'][o_orderkey % 2 + 1] END AS method, CASE WHEN o_orderkey % 5 > 0 THEN 'Closure' END AS action, '/' || ['api', 'web', 'other'][o_custkey % 3 + 1] || '/c' || o_custkey % 450 || '/edit' AS composed, '/c' || o_custkey % 450 || '/edit' AS suffix FROM orders),
e AS (SELECT DISTINCT registration, route FROM g JOIN r ON known AND composed = u AND (method IS NULL OR method = m) AND (action IS NULL OR action = a)), l AS (SELECT DISTINCT registration, route FROM g JOIN r ON ends_with(u, suffix) AND (method IS NULL OR method = m) AND (action IS NULL OR action = a) WHERE registration NOT IN (SELECT registration FROM e)),
matches AS (SELECT registration, route, 'exact' AS certainty FROM e UNION ALL SELECT registration, min(route), 'possible' FROM l GROUP BY 1 HAVING count(*) = 1)"""


def _registered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k, o, c = F.col("c_custkey"), F.col("o_orderkey"), F.col("o_custkey")
    routes = read(spark, sf_dir, "customer").select(name("r", k).alias("route"), pick(("GET", "POST"), k % 2).alias("method"), F.concat(F.lit("/"), pick(("api", "web", "admin"), k % 3), name("/c", k % 400, "/edit")).alias("uri"), pick(("Closure", "ViewController"), F.expr("c_custkey div 7") % 2).alias("action"))
    registrations = read(spark, sf_dir, "orders").select(o.alias("registration"), F.array(pick(("api", "web", "other"), c % 3)).alias("prefixes"), (c % 4 > 0).alias("known"), name("/c", c % 450, "/edit/").alias("uri"), F.when(o % 3 > 0, pick(("GET", "POST"), o % 2)).alias("method"), F.when(o % 5 > 0, "Closure").alias("action"), F.when(o % 4 == 0, "view").otherwise("closure").alias("kind"))
    return registrations, routes


@query(f"{_REGISTERED} SELECT * FROM matches", on_graph=False)
def registered_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.registered_routes(*_registered(spark, sf_dir))


@query(
    f"{_REGISTERED}, f AS (SELECT o_orderkey AS registration, o_orderkey % 4 = 0 AS of_view, 'v' || o_custkey % 30 AS view, CASE WHEN o_orderkey % 2 = 0 THEN 0.95 ELSE 0.8 END AS c FROM orders) SELECT route AS src, 'view:' || view AS dst, max(CASE WHEN certainty = 'exact' THEN least(c, CASE WHEN of_view THEN 0.95 ELSE 0.9 END) ELSE 0.7 END)::DOUBLE AS confidence, min(certainty) AS certainty FROM f JOIN matches USING (registration) GROUP BY 1, 2 UNION ALL SELECT registration::VARCHAR, NULL, NULL, NULL FROM f WHERE registration NOT IN (SELECT registration FROM matches)",
    on_graph=False,
)
def route_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    found, lost = routing.route_templates(*_registered(spark, sf_dir), o.select(F.col("o_orderkey").alias("registration"), name("v", F.col("o_custkey") % 30).alias("view"), F.when(F.col("o_orderkey") % 2 == 0, 0.95).otherwise(0.8).alias("confidence")))
    return found.drop("type").unionByName(lost.select(F.col("registration").cast("string").alias("src"), *(F.lit(None).cast(t).alias(c) for c, t in (("dst", "string"), ("confidence", "double"), ("certainty", "string")))))


# requests -----------------------------------------------------------------------------------------------------------------

_REQUESTS = """up(class, a, d) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION ALL SELECT class, a // 3, d + 2 FROM up WHERE a // 3 > 0 AND d < 16), req AS (SELECT DISTINCT class FROM up WHERE a = 2 AND class <> 2),
meth AS (SELECT p_partkey AS class, unnest(CASE p_partkey % 6 WHEN 0 THEN ['rules', 'authorize', 'after'] WHEN 1 THEN ['rules', 'prepareForValidation', 'passedValidation', 'failedAuthorization'] WHEN 2 THEN ['withValidator', 'validationRules'] WHEN 3 THEN ['passesAuthorization', 'failedAuthorization'] WHEN 4 THEN ['getValidatorInstance'] ELSE [] END) AS method FROM part WHERE p_partkey > 2),
decl AS (SELECT up.class, method, arg_min(m.class, d) AS owner FROM up JOIN meth m ON up.a = m.class GROUP BY 1, 2)"""


def _requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    label = lambda c: F.when(c == 2, requests.REQUEST_BASE).otherwise(c.cast("string"))
    parent = F.expr("p_partkey div 3")
    above = facts.ancestry(p.select(label(k).alias("class"), F.when(parent > 0, label(parent)).alias("parent"), F.array().cast("array<string>").alias("traits")))
    of = F.array().cast("array<string>")
    for i, names in enumerate((("rules", "authorize", "after"), ("rules", "prepareForValidation", "passedValidation", "failedAuthorization"), ("withValidator", "validationRules"), ("passesAuthorization", "failedAuthorization"), ("getValidatorInstance",))):
        of = F.when(k % 6 == i, F.array(*map(F.lit, names))).otherwise(of)
    methods = p.where("p_partkey > 2").select(label(k).alias("class"), F.explode(of).alias("method"), F.when(k % 17 == 0, "private").otherwise("public").alias("visibility"), name("rules of ", k).alias("rules"), (k % 5 == 0).alias("dynamic"))
    return p.select(label(k).alias("class"), (k % 13 == 0).alias("abstract")), methods, above


@query(
    f"""WITH RECURSIVE {_REQUESTS}, blocked AS (SELECT DISTINCT class FROM decl WHERE method IN ('getValidatorInstance', 'validationRules')), r AS (SELECT class, owner FROM decl WHERE method = 'rules' AND class NOT IN (SELECT class FROM blocked))
SELECT class::VARCHAR AS class, class % 13 = 0 AS abstract, 'rules of ' || owner AS rules, owner % 5 = 0 AS dynamic, owner::VARCHAR AS rules_owner FROM req LEFT JOIN r USING (class)""",
    on_graph=False,
)
def form_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.form_requests(*_requests(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {_REQUESTS}, h(method, place, condition) AS (VALUES ('authorize', 20, NULL), ('after', 60, NULL), ('prepareForValidation', 10, NULL), ('passedValidation', 80, 'validation_passed_or_failure_handler_returned'), ('failedAuthorization', 30, 'authorization_failed'), ('withValidator', 50, NULL), ('passesAuthorization', 20, NULL), ('getValidatorInstance', 40, NULL)),
f AS (SELECT class, method, owner, place, condition, bool_or(method = 'passesAuthorization') OVER w AS p, bool_or(method = 'authorize') OVER w AS a, bool_or(method = 'getValidatorInstance') OVER w AS g, min(CASE WHEN owner % 17 = 0 THEN place END) OVER w AS stop FROM req JOIN decl USING (class) JOIN h USING (method) WHERE class % 13 > 0 WINDOW w AS (PARTITION BY class))
SELECT class::VARCHAR AS src, owner || '::' || method AS dst, CASE WHEN condition IS NULL THEN 0.95 ELSE 0.85 END::DOUBLE AS confidence, place, condition FROM f WHERE (stop IS NULL OR place < stop) AND CASE WHEN method = 'authorize' THEN NOT p WHEN method = 'failedAuthorization' THEN p OR a WHEN method IN ('after', 'withValidator') THEN NOT g ELSE true END
UNION ALL SELECT class::VARCHAR, 'abstract_form_request_unbound', NULL, NULL, NULL FROM req WHERE class % 13 = 0""",
    on_graph=False,
)
def lifecycle_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, methods, above = _requests(spark, sf_dir)
    edges, warned = requests.lifecycle_bridges(requests.form_requests(classes, methods, above), methods, above)
    lost = warned.select(F.col("class").alias("src"), F.col("reason").alias("dst"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("condition"))
    return edges.select("src", "dst", "confidence", "place", "condition").unionByName(lost)


@query(
    "WITH c AS (SELECT 'C' || l_suppkey % 20 AS class, 'm' || l_orderkey % 200 AS method, l_linenumber AS line, l_returnflag AS syntax, l_linestatus = 'O' AND l_partkey % 4 = 0 AS dyn FROM lineitem) SELECT class || '::' || method AS src, 'validation:' || class || '::' || method || ':' || line AS dst, 'validates_with' AS type, CASE WHEN bool_or(dyn) THEN 0.75 ELSE 0.95 END::DOUBLE AS confidence, min(syntax) AS syntax, line FROM c GROUP BY class, method, line",
    on_graph=False,
)
def inline_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = read(spark, sf_dir, "lineitem").select(name("C", F.col("l_suppkey") % 20).alias("class"), name("m", F.col("l_orderkey") % 200).alias("method"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("syntax"), F.lit("required").alias("rules"), ((F.col("l_linestatus") == "O") & (F.col("l_partkey") % 4 == 0)).alias("dynamic"))
    return requests.inline_validation(calls)[1]


@query(
    "WITH c AS (SELECT 'm' || o_orderkey AS caller, 'M' || o_custkey % 50 AS model, ['view', 'update', 'delete'][o_orderkey % 3 + 1] AS ability FROM orders), p AS (SELECT 'M' || s_suppkey AS model, s_suppkey AS k FROM supplier WHERE s_suppkey % 2 = 0) SELECT DISTINCT caller AS src, 'P' || k || '::' || ability AS dst, 'authorizes_via' AS type, 0.9::DOUBLE AS confidence, ability FROM c JOIN p USING (model) WHERE ability <> 'delete' OR k % 3 = 0",
    on_graph=False,
)
def authorization_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = read(spark, sf_dir, "orders").select(name("m", "o_orderkey").alias("caller"), name("M", F.col("o_custkey") % 50).alias("model"), pick(("view", "update", "delete"), F.col("o_orderkey") % 3).alias("ability"))
    s = read(spark, sf_dir, "supplier")
    methods = s.select(name("P", "s_suppkey").alias("class"), F.explode(F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("view"), F.lit("update"), F.lit("delete"))).otherwise(F.array(F.lit("view"), F.lit("update")))).alias("method"))
    return requests.authorization_edges(calls, s.where("s_suppkey % 2 = 0").select(name("M", "s_suppkey").alias("model"), name("P", "s_suppkey").alias("policy")), methods)


@query(r"SELECT p_partkey, lower(p_brand) AS kind, 'm' || p_size % 5 AS meaning FROM part WHERE p_size % 5 < 3", on_graph=False)
def callable_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    calls = p.select("p_partkey", F.concat(F.lit(" \\App\\F"), F.col("p_brand"), (F.col("p_size") % 5).cast("string")).alias("name"))
    rules = p.select(F.concat(F.lit("app\\f"), F.lower("p_brand"), (F.col("p_size") % 5).cast("string")).alias("name"), F.upper("p_brand").alias("kind"), name("m", F.col("p_size") % 5).alias("meaning"), (F.col("p_size") % 5).alias("s")).where("s < 3").drop("s").distinct()
    return requests.callable_semantics(calls, rules).select("p_partkey", "kind", "meaning")


# accesses -----------------------------------------------------------------------------------------------------------------

_EXPRESSIONS = """WITH RECURSIVE e AS (SELECT o_orderkey AS id, o_custkey % 30 AS scope, 'C' || o_custkey % 30 AS class, CASE WHEN o_orderkey > 20 AND o_orderkey % 3 = 0 THEN 'method' ELSE ['this', 'variable', 'property', 'new', 'container', 'collect', 'validator', 'static'][o_orderkey % 8 + 1] END AS kind, CASE WHEN o_orderkey % 8 IN (3, 4) AND NOT (o_orderkey > 20 AND o_orderkey % 3 = 0) THEN 'C' || o_orderkey % 40 ELSE 'n' || o_orderkey % 4 END AS name, o_orderkey // 2 AS receiver FROM orders),
ret AS (SELECT 'C' || c AS class, 'n' || n AS method, CASE WHEN (c + n) % 5 > 0 THEN 'C' || (c * 3 + n) % 30 END AS returned FROM range(30) a(c), range(4) b(n) WHERE (c + n) % 7 > 0),
l0 AS (SELECT id, class AS type, 1.0::DOUBLE AS confidence FROM e WHERE kind = 'this' UNION ALL SELECT id, 'C' || (scope + 1) % 30, 0.8 FROM e WHERE kind = 'variable' AND name <> 'n1' UNION ALL SELECT id, 'C' || (scope + 2) % 30, 0.95 FROM e WHERE kind = 'property' AND name <> 'n2' UNION ALL SELECT id, name, 0.95 FROM e WHERE kind = 'new'
  UNION ALL SELECT id, CASE WHEN name IN ('C1', 'C2', 'C3', 'C4') THEN 'C9' ELSE name END, CASE WHEN name IN ('C1', 'C2', 'C3', 'C4') THEN 0.86 ELSE 0.9 END FROM e WHERE kind = 'container' AND name <> 'C12' UNION ALL SELECT id, CASE kind WHEN 'collect' THEN 'Illuminate\\Support\\Collection' ELSE 'Illuminate\\Contracts\\Validation\\Validator' END, 0.9 FROM e WHERE kind IN ('collect', 'validator') UNION ALL SELECT id, returned, 0.9 FROM e JOIN ret ON e.class = ret.class AND e.name = ret.method WHERE kind = 'static'),
l(id, type, confidence, d) AS (SELECT id, type, confidence, 0 FROM l0 UNION ALL SELECT e.id, ret.returned, round(l.confidence * 0.9, 2), d + 1 FROM l JOIN e ON e.receiver = l.id AND e.kind = 'method' JOIN ret ON ret.class = l.type AND ret.method = e.name WHERE d < 6)
SELECT id, type, confidence FROM l WHERE type IS NOT NULL"""


@query(_EXPRESSIONS.replace("\\\\", "\\"), on_graph=False)
def expression_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    inner = (o > 20) & (o % 3 == 0)
    expressions = read(spark, sf_dir, "orders").select(o.alias("id"), (c % 30).alias("scope"), name("C", c % 30).alias("class"), F.when(inner, "method").otherwise(pick(("this", "variable", "property", "new", "container", "collect", "validator", "static"), o % 8)).alias("kind"), F.when((o % 8).isin(3, 4) & ~inner, name("C", o % 40)).otherwise(name("n", o % 4)).alias("name"), F.expr("o_orderkey div 2").alias("receiver"))
    scopes, k = spark.range(30), F.col("id")
    names = F.explode(F.array(*[F.lit(f"n{i}") for i in range(4)]))
    variables = scopes.select(k.alias("scope"), names.alias("variable"), name("C", (k + 1) % 30).alias("type"), F.lit(0.8).alias("confidence")).where("variable <> 'n1'")
    properties = scopes.select(name("C", k).alias("class"), names.alias("property"), name("C", (k + 2) % 30).alias("type"), F.lit(0.95).alias("confidence")).where("property <> 'n2'")
    bindings = rows(spark, [("C1", "C9", 0.9), ("C2", "C9", 0.9), ("C3", "C9", 0.9), ("C4", "C9", 0.9), ("C12", None, 0.9)], "abstract string, concrete string, confidence double")
    n = F.col("n")
    returns = scopes.select("id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("n")).where("(id + n) % 7 > 0").select(name("C", k).alias("class"), name("n", n).alias("method"), F.when((k + n) % 5 > 0, name("C", (k * 3 + n) % 30)).alias("returned"))
    return accesses.expression_types(expressions, variables, properties, bindings, returns).drop("inference")


_RELATIONS = "rel(class, method, target_table, pivot_table, confidence, pivot_confidence) AS (SELECT 'C' || i, 'rel', 't' || i, CASE WHEN i % 2 = 0 THEN 'pivot' || i END, CASE WHEN i % 3 > 0 THEN 0.8 END::DOUBLE, CASE WHEN i % 4 = 0 THEN 0.6 END::DOUBLE FROM range(20) r(i))"


def _relations(spark: SparkSession) -> DataFrame:
    k = F.col("id")
    return spark.range(20).select(name("C", k).alias("class"), F.lit("rel").alias("method"), name("t", k).alias("target_table"), F.when(k % 2 == 0, name("pivot", k)).alias("pivot_table"), F.when(k % 3 > 0, F.lit(0.8)).alias("confidence"), F.when(k % 4 == 0, F.lit(0.6)).alias("pivot_confidence"))


@query(
    f"""WITH RECURSIVE {_RELATIONS}, st AS (SELECT l_orderkey AS id, l_linenumber AS position, ['where', 'rel', 'active', 'first', 'unknown', 'orderBy', 'save'][l_suppkey % 7 + 1] AS op, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) AS n FROM lineitem), s AS (SELECT * FROM st WHERE n = 1),
l(id, position, op, kind, class, tbl, relationship, confidence, go) AS (SELECT o_orderkey, 0, '', CASE WHEN o_custkey % 5 = 4 THEN 'table_query' ELSE 'model' END, 'C' || o_custkey % 20, 't' || o_custkey % 9, CAST(NULL AS VARCHAR), [1.0, 0.95, 0.85, 0.7, 0.95][o_custkey % 5 + 1]::DOUBLE, true FROM orders
  UNION ALL SELECT l.id, s.position, s.op, CASE WHEN rel.method IS NOT NULL THEN 'relationship' WHEN s.op IN ('where', 'orderBy', 'active') AND kind = 'model' THEN 'model_query' ELSE kind END, l.class, l.tbl, coalesce(rel.method, l.relationship),
    CASE WHEN rel.method IS NOT NULL THEN round(l.confidence * coalesce(rel.confidence, 0.7), 2) WHEN s.op IN ('where', 'orderBy') THEN round(l.confidence, 2) WHEN s.op = 'active' THEN round(l.confidence * 0.95, 2) ELSE l.confidence END, rel.method IS NOT NULL OR s.op IN ('where', 'orderBy', 'active')
  FROM l JOIN s ON l.id = s.id AND s.position = l.position + 1 LEFT JOIN rel ON l.class = rel.class AND s.op = rel.method WHERE go AND s.op <> 'unknown')
SELECT id, position, op AS operation, kind, class, tbl, relationship, confidence FROM l WHERE position > 0""",
    on_graph=False,
)
def access_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey")
    roots = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), pick(("this", "new", "static", "variable", "table"), c % 5).alias("kind"), name("C", c % 20).alias("class"), name("t", c % 9).alias("tbl"), F.lit(0.7).alias("confidence"))
    # SQL's order leaves items of the same part open; here the least supplier counts, wherever the rows lie. Nulls come last
    first = F.min(F.struct(F.col("l_partkey").isNull().alias("none"), "l_partkey", "l_suppkey"))
    steps = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("position")).agg(first["l_suppkey"].alias("s"))
    operation = pick(("where", "rel", "active", "first", "unknown", "orderBy", "save"), F.col("s") % 7)
    return accesses.access_steps(roots, steps.select("id", "position", operation.alias("operation"), (F.col("s") % 7 == 2).alias("scope")), _relations(spark))


@query(
    f"""WITH {_RELATIONS}, a AS (SELECT o_orderkey AS id, ['table_query', 'model', 'model_query', 'polymorphic_model', 'relationship', 'relationship'][o_orderkey % 6 + 1] AS kind, 'C' || o_custkey % 24 AS class, 't' || o_custkey % 9 AS tbl, CASE WHEN o_orderkey % 2 = 0 THEN 'reads' ELSE 'writes' END AS flow, ['attach', 'save', 'first'][o_custkey % 3 + 1] AS op FROM orders)
SELECT id, tbl, CASE kind WHEN 'table_query' THEN 'query_table' ELSE 'model_table' END AS role, 0.9::DOUBLE AS confidence FROM a WHERE kind IN ('table_query', 'model', 'model_query') UNION ALL SELECT id, unnest(['d1', 'd2']), 'possible_model_table', 0.5 FROM a WHERE kind = 'polymorphic_model'
UNION ALL SELECT id, target_table, 'relationship_related_table', 0.9 FROM a JOIN rel USING (class) WHERE kind = 'relationship' AND (flow = 'reads' OR op <> 'attach' OR pivot_table IS NULL) UNION ALL SELECT id, pivot_table, 'relationship_pivot_table', round(0.9 * coalesce(pivot_confidence, 0.75), 4) FROM a JOIN rel USING (class) WHERE kind = 'relationship' AND pivot_table IS NOT NULL AND (flow = 'reads' OR op = 'attach')""",
    on_graph=False,
)
def data_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    found = F.array(*[F.struct(F.lit(t).alias("tbl"), F.lit(0.5).alias("confidence")) for t in ("d1", "d2")])
    rows_ = read(spark, sf_dir, "orders").select(o.alias("id"), pick(("table_query", "model", "model_query", "polymorphic_model", "relationship", "relationship"), o % 6).alias("kind"), name("C", c % 24).alias("class"), name("t", c % 9).alias("tbl"), F.when(o % 6 > 3, "rel").alias("relationship"), F.lit(0.9).alias("confidence"), F.when(o % 2 == 0, "reads").otherwise("writes").alias("flow"), pick(("attach", "save", "first"), c % 3).alias("operation"), found.alias("descendants"))
    return accesses.data_targets(rows_, _relations(spark))


@query(
    """WITH s AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i, ['select', 'addSelect', 'where', 'orderBy', 'where'][l_suppkey % 5 + 1] AS op, 'f' || l_partkey % 6 AS f, l_partkey % 10 > 0 AS ok FROM lineitem), b AS (SELECT *, max(CASE WHEN op = 'select' THEN i END) OVER (PARTITION BY id) AS last FROM s)
SELECT id, bool_or(op IN ('select', 'addSelect')) AS seen, coalesce(string_agg(DISTINCT f, ',' ORDER BY f) FILTER (WHERE op IN ('select', 'addSelect') AND i >= coalesce(last, 0)), '') AS projection, coalesce(bool_and(ok) FILTER (WHERE op IN ('select', 'addSelect') AND i >= coalesce(last, 0)), false) AS projection_complete, coalesce(string_agg(DISTINCT f, ',' ORDER BY f) FILTER (WHERE op NOT IN ('select', 'addSelect')), '') AS predicates, coalesce(bool_and(ok) FILTER (WHERE op NOT IN ('select', 'addSelect')), true) AS predicates_complete FROM b GROUP BY id""",
    on_graph=False,
)
def query_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.struct(pick(("select", "addSelect", "where", "orderBy", "where"), F.col("l_suppkey") % 5).alias("operation"), F.array(name("f", F.col("l_partkey") % 6)).alias("fields"), (F.col("l_partkey") % 10 > 0).alias("complete"))
    chains = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", step.alias("s")))).alias("x"))
    return chains.select("id", accesses.query_fields(F.col("x")["s"]).alias("e")).select("id", "e.*").withColumns({"projection": joined("projection"), "predicates": joined("predicates")})


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 OR (o_custkey % 3 = 0 AND o_orderkey % 4 = 1 AND o_orderkey % 5 > 0) THEN '' WHEN o_orderkey % 4 = 1 THEN '*' ELSE 'a,b' END AS fields, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 3 = 0 ELSE o_orderkey % 5 > 0 END AS complete FROM orders", on_graph=False)
def aggregate_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    argument = F.when(o % 4 == 1, F.array(F.lit("*"))).when(o % 4 > 1, F.array(F.lit("a"), F.lit("b")))
    return read(spark, sf_dir, "orders").select("o_orderkey", accesses.aggregate_fields(pick(("count", "sum", "max"), F.col("o_custkey") % 3), argument, o % 5 > 0).alias("x")).select("o_orderkey", joined("x.fields").alias("fields"), "x.complete")


# what a running application tells --------------------------------------------------------------------------------------------


@query("SELECT 'table:' || n_name AS src, 'column:' || n_name || '.' || c AS dst, 'has_column' AS type FROM nation, (VALUES ('id'), ('region')) v(c) UNION ALL SELECT 'table:' || n_name, 'index:' || n_name || '.primary', 'has_index' FROM nation UNION ALL SELECT 'table:' || n_name, 'foreign_key:' || n_name || '.' || CASE WHEN n_nationkey % 2 = 0 THEN 'fk' ELSE 'region_id_foreign' END, 'has_foreign_key' FROM nation", on_graph=False)
def live_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    nothing = F.lit(None).cast("string")
    column = lambda n: F.struct(F.lit(n).alias("name"), F.lit("bigint").alias("type"), F.lit(False).alias("nullable"), nothing.alias("default"), F.lit(False).alias("auto_increment"), nothing.alias("comment"))
    key = F.struct(F.when(F.col("n_nationkey") % 2 == 0, "fk").alias("name"), F.array(F.lit("region"), F.lit("id")).alias("columns"), F.lit("region").alias("foreign_table"), F.array(F.lit("id")).alias("foreign_columns"), nothing.alias("on_update"), nothing.alias("on_delete"))
    index = F.struct(F.lit("primary").alias("name"), F.array(F.lit("id")).alias("columns"), F.lit(True).alias("unique"), F.lit(True).alias("primary"))
    tables = read(spark, sf_dir, "nation").select(F.lit("main").alias("source"), F.col("n_name").alias("name"), F.array(column("id"), column("region")).alias("columns"), F.array(index).alias("indexes"), F.array(key).alias("foreign_keys"))
    return live.live_schema(tables)[1]


@query("""SELECT c_custkey, regexp_replace(c_mktsegment || ' x', '[^A-Za-z0-9._-]+', '-', 'g') || '-' || sha256('{"connection":"c' || c_nationkey || '","context":"' || c_mktsegment || ' x","driver":"d","path":' || CASE WHEN c_custkey % 2 = 0 THEN '"a/' || c_custkey || '"' ELSE 'null' END || ',"relativePath":null,"schema":null,"source":"s","tenantId":null}') AS key FROM customer""", on_graph=False)
def schema_source_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    metadata = {"connection": name("c", "c_nationkey"), "context": F.concat("c_mktsegment", F.lit(" x")), "driver": F.lit("d"), "path": F.when(F.col("c_custkey") % 2 == 0, name("a/", "c_custkey")), "source": F.lit("s")}
    return read(spark, sf_dir, "customer").select("c_custkey", live.source_key(metadata).alias("key"))


@query(
    """WITH b AS (SELECT 'a' || p_partkey % 90 AS abstract, max(CASE WHEN p_partkey % 90 % 4 > 0 THEN 'c' || lpad(p_size::VARCHAR, 3, '0') END) AS concrete FROM part GROUP BY 1), al AS (SELECT 'z' || s_suppkey AS alias, 'a' || s_suppkey AS abstract FROM supplier)
SELECT 'default' AS scope, abstract, concrete, 0.9::DOUBLE AS confidence FROM b WHERE concrete IS NOT NULL UNION ALL SELECT 'default', alias, coalesce(b.concrete, al.abstract), CASE WHEN b.abstract IS NULL THEN 1 ELSE 0.9 END FROM al LEFT JOIN b USING (abstract) WHERE b.abstract IS NULL OR b.concrete IS NOT NULL UNION ALL SELECT 'contextual:' || c_custkey, 'a1', 'k' || c_nationkey, 0.95 FROM customer WHERE c_nationkey > 3
UNION ALL SELECT 'unknown', abstract, CASE WHEN substr(abstract, 2)::INT % 8 = 0 THEN 'factory_target_unknown' ELSE 'binding_target_unknown' END, NULL FROM b WHERE concrete IS NULL""",
    on_graph=False,
)
def container_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 90
    bindings = read(spark, sf_dir, "part").groupBy(k.alias("k")).agg(F.max(F.when(k % 4 > 0, F.concat(F.lit("c"), F.lpad(F.col("p_size").cast("string"), 3, "0")))).alias("concrete")).select(name("a", "k").alias("abstract"), "concrete", F.when(F.col("k") % 8 == 0, "factory").otherwise("other").alias("kind"), F.lit(0.9).alias("confidence"))
    aliases = read(spark, sf_dir, "supplier").select(name("z", "s_suppkey").alias("alias"), name("a", "s_suppkey").alias("abstract"))
    contextual = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("consumer"), F.lit("a1").alias("abstract"), F.when(F.col("c_nationkey") > 3, name("k", "c_nationkey")).alias("concrete"))
    found, unknown = live.container_records(bindings, aliases, contextual)
    return found.unionByName(unknown.select(F.lit("unknown").alias("scope"), "abstract", F.col("reason").alias("concrete"), F.lit(None).cast("double").alias("confidence")))


@query("WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(sha256('parser 1') || chr(0) || sha256(text)) AS key, doc_id FROM documents) SELECT key, min(path) AS path FROM d WHERE key NOT IN (SELECT key FROM d WHERE doc_id % 3 = 0) GROUP BY key", on_graph=False)
def sources_to_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    parsed = live.to_parse(sources.where("cast(path AS long) % 3 = 0"), rows(spark, [], "key string"), "parser 1")[0]
    return live.to_parse(sources, parsed, "parser 1")[1].select("key", "path")


@query("SELECT 'nations' AS scanner, count(*) AS n FROM nation UNION ALL SELECT 'broken', NULL", on_graph=False)
def isolated_scanners(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, warnings = live.run_scanners(spark, {"nations": lambda: read(spark, sf_dir, "nation"), "broken": lambda: read(spark, sf_dir, "no_such_table")})
    return done["nations"].agg(F.count("*").alias("n")).select(F.lit("nations").alias("scanner"), "n").unionByName(warnings.select("scanner", F.lit(None).cast("long").alias("n")))


_PATHS = "['/app/src/a' || o_custkey % 9 || '.x', 'src/vendor/' || o_custkey % 9, '/other/b', '../up', './src//c.x'][o_orderkey % 5 + 1]"


@query(f"SELECT o_orderkey, o_orderkey % 5 IN (0, 4) AS inside FROM (SELECT o_orderkey, {_PATHS} AS path FROM orders)", on_graph=False)
def project_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", live.in_project(_path(), "/app", ["src/vendor", "node_modules/"]).alias("inside"))


def _path() -> Column:
    k = F.col("o_custkey") % 9
    return F.get(F.array(name("/app/src/a", k, ".x"), name("src/vendor/", k), F.lit("/other/b"), F.lit("../up"), F.lit("./src//c.x")), (F.col("o_orderkey") % 5).cast("int"))


@query("SELECT o_custkey AS test, string_agg(DISTINCT CASE o_orderkey % 5 WHEN 0 THEN 'src/a' || o_custkey % 9 || '.x' ELSE 'src/c.x' END, ',') AS templates FROM orders WHERE o_orderkey % 5 IN (0, 4) GROUP BY 1".replace("','", "',' ORDER BY CASE o_orderkey % 5 WHEN 0 THEN 'src/a' || o_custkey % 9 || '.x' ELSE 'src/c.x' END"), on_graph=False)
def rendered_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("test"), _path().alias("path"))
    return live.rendered_templates(seen, "/app", ["src/vendor"]).withColumn("templates", joined("templates"))


@query("SELECT user_id AS test, string_agg(DISTINCT t, ',' ORDER BY t) AS tables FROM (SELECT user_id, unnest(CASE event_id % 3 WHEN 0 THEN ['t' || event_id % 20] WHEN 1 THEN ['t' || event_id % 20, 'u'] ELSE [] END) AS t FROM events) GROUP BY 1", on_graph=False)
def touched_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = name("T", F.col("event_id") % 20)
    sql = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("SELECT * FROM "), t)).when(F.col("event_id") % 3 == 1, F.concat(F.lit("INSERT INTO u SELECT 1 FROM main."), t)).otherwise("SELECT 1")
    return live.touched_tables(read(spark, sf_dir, "events").select(F.col("user_id").alias("test"), sql.alias("sql"))).withColumn("tables", joined("tables"))


@query("SELECT user_id AS test, CASE WHEN count(*) FILTER (WHERE value > 0) = 0 AND user_id % 2 = 0 THEN NULL ELSE coalesce(string_agg(DISTINCT event_id % 50, ',' ORDER BY event_id % 50) FILTER (WHERE value > 0), '') END AS lines FROM events WHERE event_id % 3 = 0 GROUP BY user_id", on_graph=False)
def executed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = F.collect_list(F.struct((F.col("event_id") % 50).alias("line"), F.when(F.col("value") > 0, 1).otherwise(0).alias("count")))
    traces = read(spark, sf_dir, "events").where("event_id % 3 = 0").groupBy(F.col("user_id").alias("test")).agg(trace.alias("t"))
    return traces.select("test", F.array_join(live.executed_lines(F.col("t"), F.col("test") % 2 == 0), ",").alias("lines"))


# templates ----------------------------------------------------------------------------------------------------------------


def _templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    other, gone = name("p", k % 50), name("gone", k % 3)
    source = F.concat(F.lit("{{-- @include('no') --}} @extends('layout') @include(\""), other, F.lit("\") @includeIf('"), gone, F.lit("') @includeFirst(['"), other, F.lit("', \"x,y\", 'p1'], ['a' => foo(1, 2)]) @includeFirst($list)"))
    return read(spark, sf_dir, "part").where("p_partkey <= 60").select(name("p", k).alias("name"), source.alias("source")).unionByName(rows(spark, [("layout", "@yield('x')")], "name string, source string"))


_OF_PART = "WITH t AS (SELECT 'p' || p_partkey AS name, 'p' || p_partkey % 50 AS other, 'gone' || p_partkey % 3 AS gone FROM part WHERE p_partkey <= 60), every AS (SELECT name FROM t UNION ALL SELECT 'layout')"


@query(f"{_OF_PART} SELECT 'view:' || name AS src, 'view:layout' AS dst, 'extends' AS type, 0.95::DOUBLE AS confidence FROM t UNION ALL SELECT 'view:' || name, 'view:' || other, 'includes', 0.95 FROM t WHERE other IN (SELECT name FROM every)", on_graph=False)
def template_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.template_edges(_templates(spark, sf_dir))


@query(f"{_OF_PART} SELECT name AS src, gone AS target FROM t UNION SELECT name, other FROM t WHERE other NOT IN (SELECT name FROM every)", on_graph=False)
def missing_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.missing_templates(_templates(spark, sf_dir))


@query(f"{_OF_PART} SELECT name, 'includeFirst' AS directive, '[''' || other || ''', \"x,y\", ''p1'']|[''a'' => foo(1, 2)]' AS arguments FROM t UNION ALL SELECT name, 'includeFirst', '$list' FROM t", on_graph=False)
def directive_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.directives(_templates(spark, sf_dir), ("includeFirst",)).withColumn("arguments", joined("arguments", "|"))


@query(f"{_OF_PART} SELECT DISTINCT 'view:' || name AS src, 'view:' || x AS dst, 0.7::DOUBLE AS confidence, 'possible' AS certainty FROM t, (SELECT unnest(['other', 'p1']) AS w) w, LATERAL (SELECT CASE WHEN w = 'other' THEN other ELSE 'p1' END AS x) WHERE x IN (SELECT name FROM every) UNION ALL SELECT name, NULL, NULL, NULL FROM t", on_graph=False)
def include_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _templates(spark, sf_dir)
    edges, computed = files.include_first(files.directives(t, ("includeFirst",)), t)
    return edges.drop("type").unionByName(computed.select(F.col("name").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("certainty")))


@query("SELECT regexp_replace(p_type, ' .*', '') || '.p' || p_partkey AS name, 'a/' || regexp_replace(p_type, ' .*', '') || '/p' || p_partkey || '.blade.php' AS path FROM part WHERE p_partkey % 3 < 2 UNION ALL SELECT regexp_replace(p_type, ' .*', '') || '.p' || p_partkey, 'b/' || regexp_replace(p_type, ' .*', '') || '/p' || p_partkey || '.blade.php' FROM part WHERE p_partkey % 3 = 2", on_graph=False)
def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = F.concat(F.regexp_replace("p_type", " .*", ""), F.lit("/p"), F.col("p_partkey").cast("string"))
    p = read(spark, sf_dir, "part")
    path = lambda root, suffix: F.concat(F.lit(f"{root}/"), local, F.lit(suffix)).alias("path")
    every = p.where("p_partkey % 3 < 2").select(path("a", ".blade.php")).unionByName(p.select(path("b", ".blade.php"))).unionByName(p.select(path("a", ".x"))).unionByName(p.select(path("c", ".blade.php")))
    return files.views(every, rows(spark, [("a", 0), ("b", 1)], "root string, ordinal int"))


@query("SELECT p_partkey, CASE WHEN strlen(p_name) <= 7 THEN p_name ELSE left(p_name, 7) END AS cut, (SELECT left(text, (SELECT max(n) FROM range(51) r(n) WHERE strlen(left(text, n)) <= 50)) FROM benchmark ORDER BY item_id LIMIT 1) AS first FROM part", on_graph=False)
def cut_to_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = read(spark, sf_dir, "benchmark").orderBy("item_id").limit(1).select(text.truncate_bytes(F.col("text"), 50).alias("first"))
    return read(spark, sf_dir, "part").select("p_partkey", text.truncate_bytes(F.col("p_name"), 7).alias("cut")).join(F.broadcast(first))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'src/a' || o_custkey % 9 || '.x' WHEN 1 THEN 'src/vendor/' || o_custkey % 9 WHEN 4 THEN 'src/c.x' END AS path FROM orders", on_graph=False)
def normal_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", text.normal_path(_path(), "/app").alias("path"))


@query("""WITH i AS (SELECT item_id, 'Use \"Foo bar\" and A\\B::run in Sales.order then MyClass for ' || item_id AS t FROM benchmark) SELECT item_id, 'foo bar,a\\b::run,sales.order,use,foo,a\\b,sales,myclass' AS identifiers FROM i""".replace("\\\\", "\\"), on_graph=False)
def task_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit('Use "Foo bar" and A\\B::run in Sales.order then MyClass for '), F.col("item_id").cast("string"))
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.identifiers(t), ",").alias("identifiers"))


@query("SELECT page_id, 'Page' || page_id % 5 AS component FROM pages WHERE page_id % 3 < 2 UNION ALL SELECT page_id, NULL FROM pages WHERE page_id % 3 = 2", on_graph=False)
def page_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from latticework.operators.observe import page_component

    component = name("Page", F.col("page_id") % 5)
    body = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(' {"component": "'), component, F.lit('"}'))).when(F.col("page_id") % 3 == 1, F.concat(F.lit('<div data-page="{&quot;component&quot;:&quot;'), component, F.lit('&quot;}">'), F.col("html"))).otherwise(F.lit("<p>no page data</p>"))
    return read(spark, sf_dir, "pages").select("page_id", page_component(body).alias("component"))
