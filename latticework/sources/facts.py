"""Graph facts from parsed facts: classes, call sites, bindings, routes and listeners given as tables.

The languages and frameworks that such facts come from are parsed elsewhere; what is here is the relational part, from the
facts to nodes and edges with their confidences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of operations that read and write records (fixed values).
READ_OPERATIONS = ("all", "avg", "count", "cursor", "cursorPaginate", "exists", "find", "findMany", "findOrFail", "first", "firstOr", "firstOrFail", "get", "load", "loadMissing", "max", "min", "paginate", "pluck", "simplePaginate", "sum", "value")
WRITE_OPERATIONS = ("attach", "create", "decrement", "delete", "deleteQuietly", "destroy", "detach", "firstOrCreate", "forceCreate", "forceDelete", "increment", "insert", "restore", "restoreQuietly", "save", "saveMany", "saveQuietly", "sync", "syncWithoutDetaching", "toggle", "truncate", "update", "updateOrCreate", "updateQuietly", "upsert")
PIVOT_OPERATIONS = ("attach", "detach", "sync", "syncWithoutDetaching", "toggle")

#: Effects of helper calls by what they are called on (fixed values): kind of node, kind of edge, operations.
EFFECTS = (
    ("cache", "cache", "reads_cache", ("get", "getMultiple", "has", "many", "remember", "rememberForever")),
    ("cache", "cache", "writes_cache", ("add", "decrement", "flush", "forget", "forever", "increment", "put", "putMany", "pull", "remember", "rememberForever")),
    ("storage", "filesystem", "reads_filesystem", ("download", "exists", "get", "lastModified", "missing", "readStream", "size", "temporaryUrl", "url")),
    ("storage", "filesystem", "writes_filesystem", ("append", "copy", "delete", "deleteDirectory", "makeDirectory", "move", "prepend", "put", "putFile", "putFileAs", "writeStream")),
    ("http", "external_service", "calls_external", ("delete", "get", "head", "patch", "post", "put", "send")),
)


def flow_types(operation: Column) -> Column:
    """reads, writes, both or neither, by the name of an operation."""
    return F.array_compact(F.array(F.when(operation.isin(*READ_OPERATIONS), "reads"), F.when(operation.isin(*WRITE_OPERATIONS), "writes")))


def operation_confidence(operation: Column, kind: Column) -> Column:
    return F.when(operation.isin("firstOrCreate", "updateOrCreate") & (kind == "writes"), 0.65).when(operation.isin("exists", "count", "pluck", "value"), 0.95).otherwise(0.9)


def data_flow(calls: DataFrame) -> DataFrame:
    """(src, dst, type, confidence, operations): accesses of methods to tables. calls: (method, tbl, operation, line, fields, coverage, confidence)."""
    each = calls.withColumn("type", F.explode(flow_types(F.col("operation")))).withColumn("own", F.round(F.col("confidence") * operation_confidence(F.col("operation"), F.col("type")), 2))
    key = F.concat(F.lpad(F.col("line").cast("string"), 9, "0"), F.lit(":"), "operation")
    op = F.struct(key.alias("key"), F.col("operation"), F.col("line"), F.array_sort(F.array_distinct("fields")).alias("fields"), F.col("coverage"))
    return each.groupBy(F.col("method").alias("src"), F.concat(F.lit("table:"), "tbl").alias("dst"), "type").agg(F.max("own").alias("confidence"), F.array_sort(F.collect_set(op)).alias("operations"))


def side_effects(calls: DataFrame) -> DataFrame:
    """(src, dst, type, confidence): effects on caches, files and services. calls: (method, root, operation, scope, target)."""
    options = F.array(*[F.struct(F.lit(root).alias("root"), F.lit(node).alias("node"), F.lit(edge).alias("edge"), F.array(*map(F.lit, ops)).alias("ops")) for root, node, edge, ops in EFFECTS])
    each = calls.withColumn("e", F.explode(F.filter(options, lambda o: (o["root"] == F.col("root")) & F.array_contains(o["ops"], F.col("operation")))))
    target = F.when((F.col("root") == "cache") & (F.col("operation") == "flush"), "*").otherwise(F.col("target"))
    node = F.concat_ws(":", F.lit("side-effect"), F.col("e.node"), F.coalesce("scope", F.lit("default")), F.coalesce(target, F.lit("{dynamic}")))
    return each.select(F.col("method").alias("src"), node.alias("dst"), F.col("e.edge").alias("type"), F.when(target.isNotNull(), 0.95).otherwise(0.45).alias("confidence")).groupBy("src", "dst", "type").agg(F.max("confidence").alias("confidence"))


def dispatches(calls: DataFrame) -> DataFrame:
    """(src, dst, confidence, occurrences, modes, methods, mode): dispatch edges with every call site; one mode, else mixed.

    calls: (method, target, kind, operation, line, offset, mode, confidence).
    """
    key = F.concat(F.lpad(F.col("line").cast("string"), 6, "0"), F.lit(":"), F.substring(F.sha2(F.concat_ws("|", "operation", F.col("offset").cast("string")), 256), 1, 8))
    site = F.struct(key.alias("key"), "kind", F.col("operation").alias("method"), "mode")
    rows = calls.groupBy(F.col("method").alias("src"), F.col("target").alias("dst")).agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_set(site)).alias("occurrences"), F.array_sort(F.collect_set("mode")).alias("modes"), F.array_sort(F.collect_set("operation")).alias("methods"))
    return rows.withColumn("mode", F.when(F.size("modes") == 1, F.col("modes")[0]).otherwise("mixed"))


def dispatch_mode(operation: Column, kind: Column, known: Column, queued: Column) -> Column:
    return F.when(operation == "dispatchAfterResponse", "after_response").when(operation == "broadcast", "broadcast").when((operation == "dispatchSync") | (kind == "event"), "sync").when(~known, "unknown").when(queued, "queued").otherwise("sync")


def job_chain(chains: DataFrame) -> DataFrame:
    """(src, dst, position, confidence, causal): members of ordered chains; only a first member of a public method is proven."""
    each = chains.select("method", "public", F.posexplode("jobs").alias("position", "dst"))
    proven = (F.col("position") == 0) & F.col("public")
    return each.select(F.col("method").alias("src"), "dst", "position", F.when(proven, 0.9).otherwise(0.7).alias("confidence"), F.when(proven, F.lit(None).cast("boolean")).otherwise(F.lit(False)).alias("causal"))


def listeners(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registrations (listener to event) and proven executions (event to method), of (listener, method, event, confidence, binding, proven)."""
    c = F.round(F.col("confidence") * F.col("binding"), 2).alias("confidence")
    listens = rows.select(F.col("listener").alias("src"), F.col("event").alias("dst"), F.lit("listens_to").alias("type"), c)
    return listens, rows.where("proven").select(F.col("event").alias("src"), F.concat("listener", F.lit("::"), "method").alias("dst"), F.lit("handled_by").alias("type"), c)


def ancestry(classes: DataFrame, depth: int = 8) -> DataFrame:
    """(class, ancestor, distance): a class, its traits (0 to 1) and parents, level by level; rings end.

    classes: (class, parent, traits array). Traits of a class come before its parent: distance 2k for parents, 2k + 1 for traits.
    """
    up = classes.select("class", "parent")
    level = classes.select("class", F.col("class").alias("ancestor"), F.lit(0).alias("distance"), F.array("class").alias("path"))
    out = level
    for d in range(1, depth + 1):
        level = level.join(up.select(F.col("class").alias("ancestor"), F.col("parent").alias("next")), "ancestor").where("next IS NOT NULL AND NOT array_contains(path, next)").select("class", F.col("next").alias("ancestor"), F.lit(2 * d).alias("distance"), F.concat("path", F.array("next")).alias("path"))
        out = out.unionByName(level)
    parents = out.select("class", "ancestor", "distance")
    traits = classes.select(F.col("class").alias("owner"), F.explode("traits").alias("trait"))
    return parents.unionByName(parents.join(traits, F.col("ancestor") == F.col("owner")).select("class", F.col("trait").alias("ancestor"), (F.col("distance") + 1).alias("distance"))).groupBy("class", "ancestor").agg(F.min("distance").alias("distance"))


def resolve_methods(calls: DataFrame, methods: DataFrame, above: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Call edges (src, dst, confidence) and diagnostics (caller, method, reason).

    calls: (caller, class, method, confidence); methods: (class, method). A method is looked up on the class, its traits and
    parents; a scope method answers its short name at 0.75. The product is rounded to two decimals.
    """
    scoped = methods.where("method RLIKE '^scope[A-Z]'").select("class", F.expr("concat(lower(substring(method, 6, 1)), substring(method, 7))").alias("method"), F.col("method").alias("real"), F.lit(0.75).alias("weight"), F.lit(1).alias("kind"))
    known = methods.select("class", "method", F.col("method").alias("real"), F.lit(1.0).alias("weight"), F.lit(0).alias("kind")).unionByName(scoped)
    found = calls.withColumn("i", F.monotonically_increasing_id()).join(above, "class").join(known.withColumnRenamed("class", "ancestor"), ["ancestor", "method"])
    best = found.groupBy("caller", "class", "method", "confidence").agg(F.min_by(F.struct("ancestor", "real", "weight"), F.struct("distance", "kind", "ancestor")).alias("t"))
    edges = best.groupBy(F.col("caller").alias("src"), F.concat("t.ancestor", F.lit("::"), "t.real").alias("dst")).agg(F.max(F.round(F.col("confidence") * F.col("t.weight"), 2)).alias("confidence"))
    return edges, calls.join(best.select("caller", "class", "method"), ["caller", "class", "method"], "left_anti").select("caller", "method", F.lit("unresolved_method").alias("reason"))


def diagnostics(rows: DataFrame, samples: int = 3) -> DataFrame:
    """(caller, reason, n, first): diagnostics by caller and reason, with the first samples of each caller."""
    order = Window.partitionBy("caller").orderBy("method", "reason")
    kept = rows.withColumn("k", F.row_number().over(order))
    return kept.groupBy("caller", "reason").agg(F.count("*").alias("n"), F.expr(f"array_sort(collect_list(method) FILTER (WHERE k <= {samples}))").alias("first"))


def table_name(short: Column) -> Column:
    """The conventional table of a class name: plural, in snake case."""
    snake = F.lower(F.regexp_replace(short, "([a-z0-9])([A-Z])", "$1_$2"))
    return (
        F.when(snake.rlike("[^aeiou]y$"), F.regexp_replace(snake, "y$", "ies")).when(snake.rlike("(s|x|z|ch|sh)$"), F.concat(snake, F.lit("es")))
        .when(snake.rlike("person$"), F.regexp_replace(snake, "person$", "people")).when(snake.rlike("child$"), F.concat(snake, F.lit("ren"))).otherwise(F.concat(snake, F.lit("s")))
    )


def model_tables(models: DataFrame, above: DataFrame) -> DataFrame:
    """(class, tbl, confidence, source): tables of models: a getter's, a property's, their ancestors', else by convention.

    models: (class, short, getter, property, dynamic). An override that cannot be read gives no table.
    """
    own = models.select(F.col("class").alias("ancestor"), "getter", "property", "dynamic")
    near = above.join(own, "ancestor").where("getter IS NOT NULL OR property IS NOT NULL OR dynamic")
    best = near.groupBy("class").agg(F.min_by(F.struct("getter", "property", "dynamic"), "distance").alias("b"))
    rows = models.select("class", "short").join(best, "class", "left")
    explicit = F.coalesce("b.getter", "b.property")
    dynamic = F.coalesce("b.dynamic", F.lit(False)) & F.col("b.getter").isNull()
    source = F.when(dynamic, "unresolved_get_table_override").when(F.col("b.getter").isNotNull(), "explicit_get_table_return").when(F.col("b.property").isNotNull(), "explicit_table_property").otherwise("eloquent_table_convention")
    return rows.select("class", F.when(~dynamic, F.coalesce(explicit, table_name(F.col("short")))).alias("tbl"), F.when(dynamic, 0.0).when(explicit.isNotNull(), 1.0).otherwise(0.85).alias("confidence"), source.alias("source"))


def table_edges(tables: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """(src, dst, type, confidence) of models with a table; at most 0.5 where several sources define the table."""
    rows = tables.where("tbl IS NOT NULL").join(ambiguous.select(F.col("name").alias("tbl"), F.lit(True).alias("several")), "tbl", "left")
    return rows.select(F.col("class").alias("src"), F.concat(F.lit("table:"), "tbl").alias("dst"), F.lit("uses_table").alias("type"), F.when(F.col("several"), F.least("confidence", F.lit(0.5))).otherwise(F.col("confidence")).alias("confidence"))


def relationships(calls: DataFrame, known: DataFrame) -> DataFrame:
    """(src, dst, type, confidence, methods): relations of models, 0.75 to a known class, else 0.45 to an unknown node."""
    rows = calls.join(known.select(F.col("class").alias("target"), F.lit(True).alias("known")), "target", "left")
    dst = F.when(F.col("known"), F.col("target")).otherwise(F.concat(F.lit("unknown:relationship:"), "class", F.lit("::"), "method"))
    return rows.groupBy(F.col("class").alias("src"), dst.alias("dst"), F.col("kind").alias("type")).agg(F.max(F.when(F.col("known"), 0.75).otherwise(0.45)).alias("confidence"), F.array_sort(F.collect_set("method")).alias("methods"))


def convention_policies(classes: DataFrame, models: DataFrame) -> DataFrame:
    """(model, policy): policies named after the one model of a short name. classes, models: (class, short)."""
    unique = models.groupBy("short").agg(F.count("*").alias("n"), F.min("class").alias("model")).where("n = 1")
    return classes.where("short LIKE '%Policy'").select(F.col("class").alias("policy"), F.expr("left(short, length(short) - 6)").alias("short")).join(unique, "short").groupBy("model").agg(F.min("policy").alias("policy"))


def effective_bindings(bindings: DataFrame, depth: int = 6) -> DataFrame:
    """(abstract, concrete, confidence): ends of chains of bindings, confidences multiplied and rounded to two decimals; rings have none.

    bindings: (abstract, concrete, confidence).
    """
    step = bindings.select(F.col("abstract").alias("a"), F.col("concrete").alias("next"), F.col("confidence").alias("c"))
    level, done = bindings.select("abstract", "concrete", F.round("confidence", 2).alias("confidence"), F.array("abstract", "concrete").alias("path")), None
    for _ in range(depth):
        ends = level.join(step, F.col("concrete") == F.col("a"), "left_anti").select("abstract", "concrete", "confidence")
        done = ends if done is None else done.unionByName(ends)
        level = level.join(step, F.col("concrete") == F.col("a")).where(~F.array_contains("path", F.col("next"))).select("abstract", F.col("next").alias("concrete"), F.round(F.col("confidence") * F.col("c"), 2).alias("confidence"), F.concat("path", F.array("next")).alias("path"))
    return done.groupBy("abstract", "concrete").agg(F.max("confidence").alias("confidence"))


def routes(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Route nodes and their edges. raw: (methods array, uri, domain, name, action, confidence, binding, middleware array).

    One node for each method; routes_to at the product, rounded to two decimals; middleware in order, each with its places.
    """
    uri = F.when(F.col("domain").isNotNull(), F.concat(F.lit("//"), "domain", F.lit("/"), F.ltrim(F.col("uri"), F.lit("/")))).otherwise(F.ltrim(F.col("uri"), F.lit("/")))
    each = raw.withColumn("verb", F.explode("methods")).withColumn("id", F.concat(F.lit("route:"), "verb", F.lit(":"), uri))
    nodes = each.select("id", F.lit("route").alias("type"), F.concat_ws(" ", "verb", "uri").alias("label"), "name")
    to = each.where("action IS NOT NULL").select(F.col("id").alias("src"), F.col("action").alias("dst"), F.lit("routes_to").alias("type"), F.round(F.col("confidence") * F.col("binding"), 2).alias("confidence"), F.array().cast("array<string>").alias("places"))
    place = F.concat(F.lpad(F.col("pos").cast("string"), 6, "0"), F.lit(":"), F.substring(F.sha2("m", 256), 1, 8))
    through = each.select("id", F.posexplode("middleware").alias("pos", "m")).groupBy(F.col("id").alias("src"), F.col("m").alias("dst")).agg(F.array_sort(F.collect_list(place)).alias("places")).select("src", "dst", F.lit("passes_through").alias("type"), F.lit(1.0).alias("confidence"), "places")
    return nodes, to.unionByName(through)


def handlers(found: DataFrame, conventional: DataFrame) -> DataFrame:
    """(src, dst, type, confidence): jobs and their handlers: mapped ones, else the conventional method at 0.95."""
    jobs = found.select("job").unionByName(conventional.select("job")).distinct()
    mapped = found.where("handler IS NOT NULL").groupBy("job").agg(F.min("handler").alias("handler"), F.max("binding").alias("binding"))
    rows = jobs.join(mapped, "job", "left")
    return rows.select(F.col("job").alias("src"), F.concat(F.coalesce("handler", F.col("job")), F.lit("::handle")).alias("dst"), F.lit("handled_by").alias("type"), F.round(F.lit(0.95) * F.coalesce("binding", F.lit(1.0)), 2).alias("confidence"))
