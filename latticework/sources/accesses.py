"""What expressions are: receivers' types, accesses to tables, and the fields that query chains name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.sources.facts import PIVOT_OPERATIONS, READ_OPERATIONS, WRITE_OPERATIONS

COLLECTION, VALIDATOR = "Illuminate\\Support\\Collection", "Illuminate\\Contracts\\Validation\\Validator"
#: Operations that return the query they are called on (fixed values).
PASSTHROUGH = (
    "crossJoin", "distinct", "from", "groupBy", "groupByRaw", "having", "havingRaw", "join", "latest", "leftJoin", "limit", "newQuery", "oldest", "on", "orWhere", "orWhereRaw", "orderBy",
    "orderByRaw", "query", "reorder", "rightJoin", "select", "addSelect", "selectRaw", "take", "tap", "unless", "when", "where", "whereBelongsTo", "whereBetween", "whereColumn", "whereDate",
    "whereDoesntHave", "whereHas", "whereIn", "whereKey", "whereKeyNot", "whereNotBetween", "whereNotIn", "whereNotNull", "whereNull", "whereRaw", "with", "withCount", "withWhereHas", "without",
    "withoutGlobalScope", "withoutGlobalScopes",
)


def expression_types(expressions: DataFrame, variables: DataFrame, properties: DataFrame, bindings: DataFrame, returns: DataFrame, depth: int = 6) -> DataFrame:
    """(id, type, confidence, inference): types of the expressions that calls are made on, from the innermost outwards.

    expressions: (id, scope, class, kind, name, receiver), kind being this, variable, property, new, container, collect, validator,
    static or method, and receiver the id of the expression that a method is called on; variables: (scope, variable, type,
    confidence); properties: (class, property, type, confidence); bindings: (abstract, concrete, confidence), concrete null where
    not known; returns: (class, method, returned), with inherited methods. What is not known has no row.
    """
    e = expressions
    own = lambda df, kind, confidence, inference: df.select("id", F.col(kind).alias("type"), confidence.cast("double").alias("confidence"), F.lit(inference).alias("inference"))
    bound = bindings.select(F.col("abstract").alias("name"), "concrete", F.col("confidence").alias("of_binding"), F.lit(True).alias("bound"))
    made = e.where("kind = 'container'").join(bound, "name", "left")
    known = [
        own(e.where("kind = 'this'"), "class", F.lit(1.0), "this"),
        e.where("kind = 'variable'").join(variables.withColumnRenamed("variable", "name"), ["scope", "name"]).select("id", "type", "confidence", F.lit("variable").alias("inference")),
        e.where("kind = 'property'").join(properties.withColumnRenamed("property", "name"), ["class", "name"]).select("id", "type", "confidence", F.lit("property").alias("inference")),
        own(e.where("kind = 'new'"), "name", F.lit(0.95), "new_expression"),
        own(made.where("concrete IS NOT NULL"), "concrete", F.round(F.col("of_binding") * 0.95, 2), "container_binding"),
        own(made.where("bound IS NULL"), "name", F.lit(0.9), "container_helper"),
        own(e.where("kind = 'collect'").withColumn("what", F.lit(COLLECTION)), "what", F.lit(0.9), "collection_helper"),
        own(e.where("kind = 'validator'").withColumn("what", F.lit(VALIDATOR)), "what", F.lit(0.9), "validator_helper"),
        e.where("kind = 'static'").join(returns.withColumnRenamed("method", "name"), ["class", "name"]).select("id", F.col("returned").alias("type"), F.lit(0.9).alias("confidence"), F.lit("declared_static_return_type").alias("inference")),
    ]
    level = known[0]
    for k in known[1:]:
        level = level.unionByName(k)
    out = level
    calls = e.where("kind = 'method'").select(F.col("id").alias("call"), F.col("name").alias("method"), "receiver")
    result = returns.select(F.col("class").alias("type"), "method", "returned")
    for _ in range(depth):  # a call's receiver is one level further in
        level = level.select(F.col("id").alias("receiver"), "type", F.col("confidence").alias("of_receiver")).join(calls, "receiver").join(result, ["type", "method"]).select(F.col("call").alias("id"), F.col("returned").alias("type"), F.round(F.col("of_receiver") * 0.9, 2).alias("confidence"), F.lit("declared_return_type").alias("inference"))
        out = out.unionByName(level)
    return out.where("type IS NOT NULL")


def _hundredths(c: Column) -> Column:
    """Two places of a product of doubles as SQL engines round it: 0.3 * 0.95 is below 0.285, which its decimal digits hide."""
    return F.round(c * 100) / 100


def access_steps(roots: DataFrame, steps: DataFrame, relationships: DataFrame, depth: int = 8) -> DataFrame:
    """(id, operation, kind, class, tbl, relationship, confidence): the access at each step of call chains on models and tables.

    roots: (id, kind: this, variable, new, static or table, class, tbl, confidence); steps: (id, position from 1, operation, scope:
    whether it is a local scope); relationships: (class, method, target_table, pivot_table, confidence). A relationship's
    method turns the access into one of that relationship; operations that return the query keep it, a local scope at 0.95;
    an operation that reads or writes ends the chain, any other one loses it.
    """
    factor = F.when(F.col("kind") == "this", 1.0).when(F.col("kind").isin("new", "table"), 0.95).when(F.col("kind") == "static", 0.85).otherwise(F.col("confidence"))
    level = roots.select("id", F.when(F.col("kind") == "table", "table_query").otherwise("model").alias("kind"), "class", "tbl", F.lit(None).cast("string").alias("relationship"), factor.cast("double").alias("confidence"))
    rel = relationships.select("class", F.col("method").alias("operation"), F.col("method").alias("of"), F.col("confidence").alias("r"))
    out = None
    for k in range(1, depth + 1):
        at = level.join(steps.where(F.col("position") == k).select("id", "operation", F.coalesce("scope", F.lit(False)).alias("scope")), "id").join(rel, ["class", "operation"], "left")
        passes = F.col("operation").isin(*PASSTHROUGH) | F.col("scope")
        ends = F.col("operation").isin(*READ_OPERATIONS, *WRITE_OPERATIONS)
        at = at.where(F.col("of").isNotNull() | passes | ends)
        kind = F.when(F.col("of").isNotNull(), "relationship").when(passes & (F.col("kind") == "model"), "model_query").otherwise(F.col("kind"))
        confidence = F.when(F.col("of").isNotNull(), _hundredths(F.col("confidence") * F.coalesce("r", F.lit(0.7)))).when(passes, _hundredths(F.col("confidence") * F.when(F.col("scope"), 0.95).otherwise(1.0))).otherwise(F.col("confidence"))
        row = at.select("id", "operation", kind.alias("kind"), "class", "tbl", F.coalesce("of", "relationship").alias("relationship"), confidence.alias("confidence"), (F.col("of").isNotNull() | passes).alias("open"))
        shown = row.drop("open").withColumn("position", F.lit(k))
        out = shown if out is None else out.unionByName(shown)
        level = row.where("open").drop("open", "operation")
    return out


def data_targets(accesses: DataFrame, relationships: DataFrame) -> DataFrame:
    """(id, tbl, role, confidence): the tables that an access touches.

    accesses: (id, kind, class, tbl, relationship, confidence, flow: reads or writes, operation, descendants array<struct<tbl,confidence>>).
    A query's own table; the tables of a model's descendants; of a relationship the related table and, read, its pivot table at
    the pivot's confidence (0.75 if not known). Operations on the pivot alone write that instead.
    """
    rel = relationships.select("class", F.col("method").alias("relationship"), "target_table", "pivot_table", "pivot_confidence")
    rows = accesses.join(rel, ["class", "relationship"], "left")
    target = lambda tbl, role, confidence: F.struct(tbl.alias("tbl"), F.lit(role).alias("role"), confidence.cast("double").alias("confidence"))
    nothing = F.array().cast("array<struct<tbl:string,role:string,confidence:double>>")
    some = lambda tbl, t: F.when(tbl.isNotNull() & (tbl != ""), F.array(t)).otherwise(nothing)
    c = F.col("confidence")
    related = some(F.col("target_table"), target(F.col("target_table"), "relationship_related_table", c))
    pivot = some(F.col("pivot_table"), target(F.col("pivot_table"), "relationship_pivot_table", c * F.coalesce("pivot_confidence", F.lit(0.75))))
    on_pivot = F.col("operation").isin(*PIVOT_OPERATIONS) & (F.size(pivot) > 0)
    targets = (
        F.when(F.col("kind") == "table_query", F.array(target(F.col("tbl"), "query_table", c))).when(F.col("kind").isin("model", "model_query"), F.array(target(F.col("tbl"), "model_table", c)))
        .when(F.col("kind") == "polymorphic_model", F.transform("descendants", lambda d: target(d["tbl"], "possible_model_table", d["confidence"])))
        .when((F.col("kind") == "relationship") & (F.col("flow") == "writes"), F.when(on_pivot, pivot).otherwise(related)).when(F.col("kind") == "relationship", F.concat(related, pivot))
    )
    return rows.select("id", F.explode(targets).alias("t")).select("id", "t.tbl", "t.role", F.round("t.confidence", 4).alias("confidence")).where("tbl IS NOT NULL")


_EVIDENCE = "struct<seen:boolean,projection:array<string>,projection_complete:boolean,predicates:array<string>,predicates_complete:boolean>"


def query_fields(steps: Column) -> Column:
    """Fields that a query's chain names, from steps array<struct<operation,fields,complete>> in order.

    A selection replaces the projection, a further one adds to it (if there is one), all others name predicates. The result is
    struct<seen,projection,projection_complete,predicates,predicates_complete>; lists are distinct and sorted.
    """
    union = lambda a, b: F.array_sort(F.array_distinct(F.concat(a, b)))
    nothing = F.array().cast("array<string>")

    def step(a: Column, s: Column) -> Column:
        select, add = s["operation"] == "select", s["operation"] == "addSelect"
        projection = F.when(select, union(s["fields"], nothing)).when(add, union(F.when(a["seen"], a["projection"]).otherwise(nothing), s["fields"])).otherwise(a["projection"])
        complete = F.when(select, s["complete"]).when(add, F.when(a["seen"], a["projection_complete"]).otherwise(True) & s["complete"]).otherwise(a["projection_complete"])
        other = ~(select | add)
        return F.struct(
            (a["seen"] | select | add).alias("seen"), projection.alias("projection"), complete.alias("projection_complete"),
            F.when(other, union(a["predicates"], s["fields"])).otherwise(a["predicates"]).alias("predicates"), (a["predicates_complete"] & (~other | s["complete"])).alias("predicates_complete"),
        ).cast(_EVIDENCE)

    start = F.struct(F.lit(False).alias("seen"), nothing.alias("projection"), F.lit(False).alias("projection_complete"), nothing.alias("predicates"), F.lit(True).alias("predicates_complete")).cast(_EVIDENCE)
    return F.aggregate(steps, start, step)


def aggregate_fields(operation: Column, argument: Column, complete: Column) -> Column:
    """struct<fields,complete> of avg, count, max, min and sum: their argument's fields; counting rows touches no column."""
    nothing = F.array().cast("array<string>")
    star = (operation == "count") & complete & (F.size(argument) == 1) & (F.get(argument, F.lit(0)) == "*")
    return F.when(argument.isNull(), F.struct(nothing.alias("fields"), (operation == "count").alias("complete"))).when(star, F.struct(nothing.alias("fields"), F.lit(True).alias("complete"))).otherwise(F.struct(argument.alias("fields"), complete.alias("complete")))
