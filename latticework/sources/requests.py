"""Facts of request validation: which classes are requests, their rules, the hooks that the framework runs, inline validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REQUEST_BASE = "Illuminate\\Foundation\\Http\\FormRequest"
#: Methods that replace the default way to a request's rules (fixed values).
RULE_OVERRIDES = ("validator", "validateResolved", "getValidatorInstance", "createDefaultValidator", "validationRules")
#: Hooks of a request's life in their order: name, place, phase, condition, and whether it runs before the controller does
#: (fixed values). An override of validateResolved runs alone; one of passesAuthorization hides authorize, one of
#: getValidatorInstance those with places from 35 to 62.
LIFECYCLE = (
    ("validateResolved", 0, "validation_lifecycle", None),
    ("prepareForValidation", 10, "preparation", None),
    ("passesAuthorization", 20, "authorization", None),
    ("authorize", 20, "authorization", None),
    ("failedAuthorization", 30, "authorization", "authorization_failed"),
    ("configureFromAttributes", 35, "validator_configuration", None),
    ("getValidatorInstance", 40, "validator_creation", None),
    ("validator", 40, "validator_creation", None),
    ("withValidator", 50, "validator_configuration", None),
    ("after", 60, "validator_configuration", None),
    ("shouldFailOnUnknownFields", 61, "unknown_fields", None),
    ("validateNoUnknownFields", 62, "unknown_fields", "unknown_field_validation_enabled"),
    ("failedValidation", 70, "validation_result", "validation_failed"),
    ("passedValidation", 80, "validation_result", "validation_passed_or_failure_handler_returned"),
)


def declarations(methods: DataFrame, above: DataFrame) -> DataFrame:
    """(class, method, owner, visibility, ...): the nearest declaration of each method, on a class, its traits or its parents."""
    others = [c for c in methods.columns if c not in ("class", "method")]
    own = methods.withColumnRenamed("class", "ancestor")
    near = above.join(own, "ancestor").groupBy("class", "method").agg(F.min_by(F.struct(F.col("ancestor").alias("owner"), *others), F.struct("distance", "ancestor")).alias("d"))
    return near.select("class", "method", "d.*")


def form_requests(classes: DataFrame, methods: DataFrame, above: DataFrame) -> DataFrame:
    """(class, abstract, rules, dynamic, rules_owner): classes below the framework's request, with the rules that are active.

    classes: (class, abstract); methods: (class, method, rules, dynamic); above: (class, ancestor, distance). The nearest rules
    method counts, unless a method of RULE_OVERRIDES is declared on the way.
    """
    requests = above.where(F.col("ancestor") == REQUEST_BASE).select("class").distinct().where(F.col("class") != REQUEST_BASE)
    known = declarations(methods.select("class", "method", "rules", "dynamic"), above)
    overridden = known.where(F.col("method").isin(*RULE_OVERRIDES)).select("class").distinct()
    rules = known.where("method = 'rules'").join(overridden, "class", "left_anti").select("class", "rules", "dynamic", F.col("owner").alias("rules_owner"))
    return classes.join(requests, "class", "left_semi").select("class", F.coalesce("abstract", F.lit(False)).alias("abstract")).join(rules, "class", "left")


def lifecycle_bridges(requests: DataFrame, methods: DataFrame, above: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hooks that the framework invokes (src, dst, type, confidence, place, phase, condition) and abstract requests (class, reason).

    requests: (class, abstract); methods: (class, method, visibility). A private hook is not called: the life of the request is
    not followed beyond its place. failedAuthorization needs a hook that can fail.
    """
    warned = requests.where("abstract").select("class", F.lit("abstract_form_request_unbound").alias("reason"))
    table = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(place).alias("place"), F.lit(phase).alias("phase"), F.lit(condition).cast("string").alias("condition")) for m, place, phase, condition in LIFECYCLE])
    rules = requests.where("NOT abstract").select("class", F.explode(table).alias("r")).select("class", "r.*")
    found = rules.join(declarations(methods.select("class", "method", "visibility"), above), ["class", "method"])
    has = lambda m: F.max(F.col("method") == m).over(every)
    every = Window.partitionBy("class")
    state = found.withColumns({f"has_{m}": has(m) for m in ("validateResolved", "passesAuthorization", "authorize", "getValidatorInstance")})
    stop = F.min(F.when(F.col("visibility") == "private", F.col("place"))).over(every)
    live = state.withColumn("stop", stop).where(
        F.when(F.col("has_validateResolved"), F.col("method") == "validateResolved")
        .when(F.col("method") == "authorize", ~F.col("has_passesAuthorization"))
        .when(F.col("method") == "failedAuthorization", F.col("has_passesAuthorization") | F.col("has_authorize"))
        .when(F.col("place").between(35, 62) & (F.col("method") != "getValidatorInstance"), ~F.col("has_getValidatorInstance"))
        .otherwise(True)
    ).where("stop IS NULL OR place < stop")
    return live.select(F.col("class").alias("src"), F.concat("owner", F.lit("::"), "method").alias("dst"), F.lit("framework_invokes").alias("type"), F.when(F.col("condition").isNotNull(), 0.85).otherwise(0.95).alias("confidence"), "place", "phase", "condition"), warned


def inline_validation(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Request nodes and edges of validation calls in methods: 0.95, or 0.75 where the rules are computed.

    calls: (class, method, line, syntax, rules, dynamic); a line of a method is one node, with the first syntax by name.
    """
    caller = F.concat("class", F.lit("::"), "method")
    one = calls.groupBy(caller.alias("src"), F.concat(F.lit("validation:"), caller, F.lit(":"), F.col("line").cast("string")).alias("dst"), "line").agg(F.min_by(F.struct("syntax", "rules"), "syntax").alias("x"), F.max(F.coalesce("dynamic", F.lit(False))).alias("dynamic"))
    label = F.concat(F.element_at(F.split("src", r"\\"), -1), F.lit(" inline validation"))
    nodes = one.select(F.col("dst").alias("id"), F.lit("form_request").alias("type"), label.alias("label"), "line", "x.rules", "dynamic")
    return nodes, one.select("src", "dst", F.lit("validates_with").alias("type"), F.when(F.col("dynamic"), 0.75).otherwise(0.95).alias("confidence"), "x.syntax", "line")


def authorization_edges(calls: DataFrame, policies: DataFrame, methods: DataFrame) -> DataFrame:
    """(src, dst, type, confidence, ability): checks of an ability on a model, to the method of its policy that has the ability's name.

    calls: (caller, model, ability); policies: (model, policy); methods: (class, method).
    """
    rows = calls.join(policies, "model").join(methods.select(F.col("class").alias("policy"), F.col("method").alias("ability")).distinct(), ["policy", "ability"], "left_semi")
    return rows.select(F.col("caller").alias("src"), F.concat("policy", F.lit("::"), "ability").alias("dst"), F.lit("authorizes_via").alias("type"), F.lit(0.9).alias("confidence"), "ability").distinct()


def callable_semantics(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """calls (name, ...) with the meaning that users declared for exactly that function. rules: (name, kind, meaning); names in any case."""
    key: Column = F.lower(F.ltrim(F.trim("name"), F.lit("\\")))
    known = rules.select(F.lower(F.ltrim(F.trim("name"), F.lit("\\"))).alias("key"), F.lower(F.trim("kind")).alias("kind"), "meaning").where("key <> '' AND kind <> ''")
    return calls.withColumn("key", key).join(known, "key").drop("key")
