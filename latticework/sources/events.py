"""Facts of events, jobs, listeners and observers, from tables of classes, methods and calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Static calls that dispatch their class, traits that make a class an event or a job, calls that register a
#: model's events.
STATIC_DISPATCHES = ("dispatch", "dispatchSync", "dispatchAfterResponse")
EVENT_TRAIT, JOB_TRAIT = "Illuminate\\Foundation\\Events\\Dispatchable", "Illuminate\\Foundation\\Bus\\Dispatchable"
MODEL_EVENTS = ("creating", "created", "updating", "updated", "saving", "saved", "deleting", "deleted", "restoring", "restored")
FRAMEWORK_PREFIXES = ("Illuminate\\", "Laravel\\", "Symfony\\Component\\")


def class_roles(classes: DataFrame, above: DataFrame) -> DataFrame:
    """(class, role): events and jobs among classes, by namespace, by folder, or by a trait of theirs or of an ancestor.

    classes: (class, file, kind); above: (class, ancestor), as ancestry() gives it. What is an event is no job.
    """
    traits = above.where(F.col("ancestor").isin(EVENT_TRAIT, JOB_TRAIT)).groupBy("class").agg(F.max(F.col("ancestor") == EVENT_TRAIT).alias("event_trait"), F.max(F.col("ancestor") == JOB_TRAIT).alias("job_trait"))
    rows = classes.where("kind = 'class'").join(traits, "class", "left")
    whole, file = F.concat(F.lit("\\"), "class"), F.coalesce("file", F.lit(""))

    def is_a(segment: str, folder: str, trait: str) -> Column:
        return whole.contains(f"\\{segment}\\") | file.startswith(f"app/{folder}/") | F.coalesce(trait, F.lit(False))

    role = F.when(is_a("Events", "Events", "event_trait"), "event").when(is_a("Jobs", "Jobs", "job_trait"), "job")
    return rows.select("class", role.alias("role")).where("role IS NOT NULL")


def discovered_listeners(classes: DataFrame, methods: DataFrame, roles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listeners found by convention (listener, method, event, confidence) and warnings (listener, reason).

    classes: (class, file, kind, abstract); methods: (class, method, visibility, first_type). Public handle* methods and
    __invoke of classes in the listeners' folder listen to the event that their first parameter is.
    """
    found = classes.where(F.col("file").startswith("app/Listeners/"))
    usable = (F.col("kind") == "class") & ~F.coalesce("abstract", F.lit(False))
    warnings = found.where(~usable).select(F.col("class").alias("listener"), F.lit("listener_not_instantiable").alias("reason"))
    handles = methods.where((F.col("visibility") == "public") & (F.col("method").startswith("handle") | (F.col("method") == "__invoke")))
    events = roles.where("role = 'event'").select(F.col("class").alias("first_type"))
    rows = found.where(usable).select("class").join(handles, "class").join(events, "first_type", "left_semi")
    return rows.select(F.col("class").alias("listener"), "method", F.col("first_type").alias("event"), F.lit(0.85).alias("confidence")), warnings


def queue_decision(status: Column, visibility: Column, statements: Column, returned: Column) -> Column:
    """Whether a listener is queued, by what is known of its shouldQueue method: always, never, conditional, invalid, unproven."""
    constant = F.lower(returned)
    only = (statements == 1) & returned.isNotNull()
    return (
        F.when(status == "absent", "always").when((status != "found") | status.isNull(), "unproven").when(~visibility.eqNullSafe(F.lit("public")), "invalid")
        .when(only & (constant == "true"), "always").when(only & (constant == "false"), "never").otherwise("conditional")
    )


def static_calls(calls: DataFrame, roles: DataFrame, models: DataFrame, dispatchable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What static calls do (src, dst, type, kind, confidence, line) and warnings (src, class, operation, reason).

    calls: (method, class, operation, target, line), class being a resolved name, or 'Event' or 'Bus' for these facades; models:
    (class); dispatchable: (class, role), classes whose dispatching trait is proven. Facades dispatch or register their
    target; a model's observe names an observer; a dispatching call on a class needs the proof.
    """
    dispatching = F.col("operation").isin(*STATIC_DISPATCHES)
    facade = F.col("class").isin("Event", "Bus")
    known = dispatchable.select("class", F.col("role").alias("proven"))
    kinds = roles.select("class", "role")
    rows = calls.join(models.select("class", F.lit(True).alias("model")), "class", "left").join(known, "class", "left").join(kinds, "class", "left")
    what = (
        F.when((F.col("class") == "Event") & (F.col("operation") == "dispatch"), F.struct(F.lit("dispatches").alias("type"), F.lit("event").alias("kind")))
        .when((F.col("class") == "Event") & (F.col("operation") == "listen"), F.struct(F.lit("listens_to").alias("type"), F.lit("event").alias("kind")))
        .when((F.col("class") == "Bus") & dispatching, F.struct(F.lit("dispatches").alias("type"), F.lit("job").alias("kind")))
        .when(~facade & (F.col("operation") == "observe") & F.col("model"), F.struct(F.lit("observes").alias("type"), F.lit("observer").alias("kind")))
        .when(~facade & dispatching & F.col("proven").isNotNull(), F.struct(F.lit("dispatches").alias("type"), F.col("proven").alias("kind")))
    )
    done = rows.withColumn("what", what)
    # an observer observes the model; a class's own dispatch sends the class itself
    src = F.when(F.col("what.type") == "observes", F.col("target")).otherwise(F.col("method"))
    dst = F.when(facade, F.col("target")).otherwise(F.col("class"))
    edges = done.where("what IS NOT NULL").select(src.alias("src"), dst.alias("dst"), "what.type", "what.kind", F.lit(0.9).alias("confidence"), "line").where("src IS NOT NULL AND dst IS NOT NULL")
    warned = done.where(~facade & dispatching & F.col("proven").isNull() & F.col("role").isNotNull())
    return edges, warned.select(F.col("method").alias("src"), "class", "operation", F.lit("static_dispatch_method_unproven").alias("reason"))


def observes(rows: DataFrame) -> DataFrame:
    """(src, dst, type, confidence, sources): observers of models, the best of several registrations. rows: (observer, model, confidence, source)."""
    return rows.groupBy(F.col("observer").alias("src"), F.col("model").alias("dst")).agg(F.lit("observes").alias("type"), F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("source")).alias("sources"))


def model_event_types(closures: DataFrame) -> DataFrame:
    """(class, scope, variable, type, confidence): what the first parameter of a closure is that a model registers on its own events.

    closures: (class, scope, target, operation, parameters array<struct<name,type>>). A declared type of the parameter counts
    before the registration's.
    """
    own = closures.where((F.col("target") == F.col("class")) & F.col("operation").isin(*MODEL_EVENTS) & (F.size("parameters") > 0))
    first = F.element_at("parameters", 1)
    return own.select("class", "scope", first["name"].alias("variable"), F.coalesce(first["type"], F.col("class")).alias("type"), F.when(first["type"].isNotNull(), 1.0).otherwise(0.8).alias("confidence")).where("variable IS NOT NULL")


def framework_boundary(above: DataFrame) -> DataFrame:
    """(class, boundary): the nearest of a class, its traits and its parents that belongs to the framework; classes without one have no row."""
    inside = F.lit(False)
    for p in FRAMEWORK_PREFIXES:
        inside = inside | F.col("ancestor").startswith(p)
    return above.where(inside).groupBy("class").agg(F.min_by("ancestor", F.struct("distance", "ancestor")).alias("boundary"))
