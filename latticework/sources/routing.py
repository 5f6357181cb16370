"""Facts of routes: actions, parameters, effective middleware, and the templates that registrations render."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.runtime import written


def controller_actions(actions: DataFrame, bindings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Actions through the container's bindings (route, class, requested, method, confidence) and warnings (route, requested, reason).

    actions: (route, class, method); bindings: (abstract, concrete, confidence), concrete null where a binding's target is not known.
    """
    known = bindings.select(F.col("abstract").alias("class"), "concrete", F.col("confidence").alias("of_binding"), F.lit(True).alias("bound"))
    rows = actions.join(known, "class", "left")
    unknown = F.col("bound") & F.col("concrete").isNull()
    found = rows.where(~F.coalesce(unknown, F.lit(False))).select("route", F.coalesce("concrete", "class").alias("class"), F.col("class").alias("requested"), "method", F.coalesce("of_binding", F.lit(1.0)).alias("confidence"))
    return found, rows.where(unknown).select("route", F.col("class").alias("requested"), F.lit("controller_container_target_unknown").alias("reason"))


def parameter_edges(parameters: DataFrame, classes: DataFrame, bindings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What controller parameters mean (src, dst, type, confidence, parameter, shared) and warnings (src, requested, reason).

    parameters: (method, parameter, class, route_parameters array); classes: (class, request, model, concrete) flags; bindings:
    (abstract, concrete, confidence, instance). A request is validated with at its binding's confidence, if the target is a
    concrete request that the container makes; a model is used at 0.9.
    """
    own = classes.select("class", "request", "model")
    target = classes.select(F.col("class").alias("concrete"), (F.col("request") & F.coalesce("concrete", F.lit(False))).alias("usable"))
    bound = bindings.select(F.col("abstract").alias("class"), F.col("concrete").alias("target"), F.col("confidence").alias("of_binding"), F.coalesce("instance", F.lit(False)).alias("instance"), F.lit(True).alias("bound"))
    rows = parameters.join(own, "class").join(bound, "class", "left").join(target.withColumnRenamed("concrete", "target"), "target", "left")
    has = F.coalesce("bound", F.lit(False))
    reason = (
        F.when(has & F.col("target").isNull(), "form_request_container_target_unknown").when(has & ~F.coalesce("usable", F.lit(False)), "form_request_container_target_not_concrete")
        .when(has & F.col("instance"), "form_request_existing_instance_bypasses_lifecycle")
    )
    requests = rows.where("request").withColumn("reason", reason)
    edge = lambda df, dst, kind, confidence, shared: df.select(F.col("method").alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), confidence.alias("confidence"), "parameter", shared.alias("shared"))
    shared = F.array_contains("route_parameters", F.col("parameter"))
    valid = edge(requests.where("reason IS NULL"), F.when(has, F.col("target")).otherwise(F.col("class")), "validates_with", F.when(has, F.col("of_binding")).otherwise(F.lit(1.0)), shared)
    models = edge(rows.where("model"), F.col("class"), "uses_model", F.lit(0.9), F.lit(False))
    return valid.unionByName(models), requests.where("reason IS NOT NULL").select(F.col("method").alias("src"), F.col("class").alias("requested"), "reason")


def expanded_middleware(declared: DataFrame, groups: DataFrame, aliases: DataFrame, depth: int = 4) -> DataFrame:
    """(route, place, value, declared, groups): declarations with groups replaced by their members in order, and aliases by classes.

    declared: (route, position, value); groups: (name, position, member), nested up to depth; aliases: (alias, class). What
    follows a colon in a declaration are arguments, which an alias keeps. place sorts as the declarations and members do.
    """
    rows = declared.select("route", F.array(F.col("position").cast("long")).alias("place"), F.col("value"), F.col("value").alias("declared"), F.array().cast("array<string>").alias("groups"))
    members = groups.select(F.col("name").alias("value"), F.col("position").cast("long").alias("at"), "member")
    done = None
    for _ in range(depth):
        flat = rows.join(members.select("value").distinct(), "value", "left_anti")
        done = flat if done is None else done.unionByName(flat)
        # a group inside itself is not expanded again
        rows = rows.where(~F.array_contains("groups", F.col("value"))).join(members, "value").select("route", F.concat("place", F.array("at")).alias("place"), F.col("member").alias("new"), "declared", F.concat("groups", F.array("value")).alias("groups")).withColumnRenamed("new", "value")
    name, arguments = F.substring_index("value", ":", 1), F.expr("substring(value, length(substring_index(value, ':', 1)) + 1)")
    named = done.withColumn("alias", name).join(aliases.select("alias", "class"), "alias", "left")
    return named.select("route", "place", F.when(F.col("class").isNotNull(), F.concat("class", arguments)).otherwise(F.col("value")).alias("value"), "declared", "groups")


def effective_middleware(expanded: DataFrame, excluded: DataFrame, parents: DataFrame, priority: DataFrame) -> DataFrame:
    """(route, position, value, declared): the middleware that runs, in order.

    excluded: (route, value); parents: (class, ancestor); priority: (class, rank). An exclusion takes out its value, and without
    arguments on either side the classes below it. Middleware with a rank moves before the first that has a greater one; the
    others keep their places. In terms of a sort: a ranked one by its rank, another by the greatest rank before it, then as
    declared. Of repeated values the first stays.
    """
    name = F.substring_index("value", ":", 1)
    below = parents.select(F.col("class").alias("value"), F.col("ancestor").alias("gone")).where("value <> gone")
    out = excluded.select("route", F.col("value").alias("gone"))
    left = expanded.join(out.withColumnRenamed("gone", "value"), ["route", "value"], "left_anti")
    inherited = left.select("route", "value").distinct().join(below, "value").join(out, ["route", "gone"], "left_semi").select("route", "value").distinct()
    kept = left.join(inherited, ["route", "value"], "left_anti")
    ranked = kept.withColumn("class", name).join(priority.select("class", "rank"), "class", "left")
    order = Window.partitionBy("route").orderBy("place")
    key = F.coalesce("rank", F.max("rank").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    sorted_ = ranked.withColumn("key", key)
    first = sorted_.withColumn("k", F.row_number().over(Window.partitionBy("route", "value").orderBy("key", "place"))).where("k = 1")
    return first.withColumn("position", F.row_number().over(Window.partitionBy("route").orderBy("key", "place")) - 1).select("route", "position", "value", "declared")


def middleware_provenance(resolved: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resolved middleware with the declaration of the same value and ordinal (route, position, value, declared), and those without one.

    resolved: (route, position, value); candidates: (route, place, value, declared).
    """
    nth = lambda df, by: df.withColumn("nth", F.row_number().over(Window.partitionBy("route", "value").orderBy(by)))
    rows = nth(resolved.select("route", "position", "value"), "position").join(nth(candidates.select("route", "place", "value", "declared"), "place").drop("place"), ["route", "value", "nth"], "left")
    return rows.select("route", "position", "value", "declared"), rows.where("declared IS NULL").select("route", "position", "value", F.lit("middleware_provenance_unresolved").alias("reason"))


def _fits() -> Column:
    """Whether the route (m, a) is of the method and action that a registration names, if any."""
    return (F.col("method").isNull() | (F.col("method") == F.col("m"))) & (F.col("action").isNull() | (F.col("action") == F.col("a")))


def _answered(registrations: DataFrame, routes: DataFrame, *also: str) -> tuple[DataFrame, DataFrame]:
    """Registrations with what answers them, and routes (route, m, u, a, repeated), both without copies.

    Registrations come as (registration, also, composed, method, action, repeated: its id has other rows, exact: the composed URI
    has routes; and of all rows of the id answered: one is exact, low and high: the least and greatest route that end in the
    URI). Routes are looked up once for all registrations that ask the same, and only these ends of their order are kept: no
    pairs are made here. The suffixes of registered URIs are exploded, so both lookups are equi-joins.
    """
    each = lambda df, key: df.repartition(key).distinct().withColumn("repeated", F.count("*").over(Window.partitionBy(key)) > 1)
    r = each(routes.select("route", F.col("method").alias("m"), F.col("uri").alias("u"), F.col("action").alias("a")), "route")
    trimmed = F.trim("uri", F.lit("/"))
    composed = F.rtrim(F.concat(F.lit("/"), F.ltrim(F.concat_ws("/", "prefixes", trimmed), F.lit("/"))), F.lit("/"))
    asked = F.struct("known", F.when(composed == "", "/").otherwise(composed).alias("composed"), F.concat(F.lit("/"), trimmed).alias("suffix"), "method", "action")
    kinds = registrations.select(asked.alias("asked")).distinct().select("asked", "asked.*")
    ends = r.groupBy("u", "m", "a").agg(F.min("route").alias("low"), F.max("route").alias("high"))
    exact = kinds.where("known").join(ends, (F.col("composed") == F.col("u")) & _fits(), "left_semi").select("asked", F.lit(True).alias("exact"), F.lit(None).cast("string").alias("low"), F.lit(None).cast("string").alias("high"))
    segments = F.split(F.ltrim("u", F.lit("/")), "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(segments, i, F.size(segments)), "/")))
    tailed = ends.select("m", "a", "low", "high", F.explode(F.array_distinct(tails)).alias("tail")).groupBy("tail", "m", "a").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    loose = kinds.where("suffix <> '/'").join(tailed, (F.col("suffix") == F.col("tail")) & _fits()).select("asked", F.lit(False).alias("exact"), "low", "high")
    answers = written(exact.unionByName(loose).groupBy("asked").agg(F.max("exact").alias("exact"), F.min("low").alias("low"), F.max("high").alias("high")), "route-answers")
    id_ = Window.partitionBy("registration")
    rows = each(registrations.select("registration", *also, asked.alias("asked")), "registration").join(answers, "asked", "left").withColumn("exact", F.coalesce("exact", F.lit(False)))
    rows = rows.withColumns({"answered": F.max("exact").over(id_), "low": F.min("low").over(id_), "high": F.max("high").over(id_)})
    return rows.select("registration", *also, "asked.composed", "asked.method", "asked.action", "repeated", "exact", "answered", "low", "high"), r


def registered_routes(registrations: DataFrame, routes: DataFrame) -> DataFrame:
    """(registration, route, certainty): the routes that registrations made: those of the composed URI, else the only one that ends in the URI.

    registrations: (registration, prefixes array, known, uri, method, action), known telling whether the prefixes are; method null
    for any; routes: (route, method, uri, action), a URI with its leading slash. Pairs are made last and are not shuffled,
    but for registrations and routes whose ids have several rows, which can give a pair more than once.
    """
    rows, r = _answered(registrations, routes)
    asking = rows.where("exact").select("registration", "composed", "method", "action", F.col("repeated").alias("again"))
    made = lambda x, y: x.join(y, (F.col("composed") == F.col("u")) & _fits()).select("registration", "route")
    exact = made(asking.where("NOT again"), r.where("NOT repeated"))
    exact = exact.unionByName(made(asking.where("again"), r).unionByName(made(asking.where("NOT again"), r.where("repeated"))).distinct())
    single = rows.where("NOT answered AND low = high").select("registration", F.col("low").alias("route")).distinct()
    return exact.withColumn("certainty", F.lit("exact")).unionByName(single.withColumn("certainty", F.lit("possible")))


def route_templates(registrations: DataFrame, routes: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Templates that registered routes render (src, dst, type, confidence, certainty) and registrations without a route.

    registrations and routes: as registered_routes() takes them, with a kind: view or closure; references: (registration, view,
    confidence). At most 0.95 for a view route and 0.9 for a closure, 0.7 where the route is only possible. Of the registrations
    that ask the same and render the same, only the best meets the routes.
    """
    rows, r = _answered(registrations, routes, "kind")
    rows = rows.join(references, "registration")
    best = F.max(F.least("confidence", F.when(F.col("kind") == "view", 0.95).otherwise(0.9))).alias("confidence")
    asking = rows.where("exact").groupBy("composed", "method", "action", "view").agg(best)
    exact = asking.join(r, (F.col("composed") == F.col("u")) & _fits()).select("route", "view", "confidence", F.lit("exact").alias("certainty"))
    single = rows.where("NOT answered AND low = high").select(F.col("low").alias("route"), "view", F.lit(0.7).alias("confidence"), F.lit("possible").alias("certainty"))
    found = exact.unionByName(single).select(F.col("route").alias("src"), F.concat(F.lit("view:"), "view").alias("dst"), F.lit("renders").alias("type"), "confidence", "certainty")
    lost = rows.where("NOT answered AND NOT coalesce(low = high, false)").select("registration").distinct()
    return found.groupBy("src", "dst", "type").agg(F.max("confidence").alias("confidence"), F.min("certainty").alias("certainty")), lost
