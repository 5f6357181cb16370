"""What a running application tells: live schemas, container snapshots, query and render events; and how scanners are run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions import text
from latticework.runtime import written
from latticework.sources import schema_dump

#: Fields that identify a source of schemas, in the order of their names (fixed values).
IDENTITY = ("connection", "context", "driver", "path", "relativePath", "schema", "source", "tenantId")
MESSAGE_BYTES = 2048


def live_schema(tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a captured live schema: tables (source, name, columns, indexes, foreign_keys), as those of a dump.

    A foreign key without a name is known by its columns.
    """
    named = F.transform("foreign_keys", lambda k: F.when(F.coalesce(k["name"], F.lit("")) != "", k).otherwise(k.withField("name", F.concat(F.array_join(k["columns"], "_"), F.lit("_foreign")))))
    return schema_dump.graph(tables.where("name IS NOT NULL").withColumn("foreign_keys", named))


def source_key(metadata: dict[str, Column]) -> Column:
    """A key of a source of schemas: its label, a hyphen, and the sha256 of its identity as canonical JSON."""
    nothing = F.lit(None).cast("string")
    value = lambda k: metadata.get(k, nothing).cast("string")
    path = F.element_at(F.split(F.coalesce(value("path"), F.lit("schema")), "/"), -1)
    label = F.regexp_replace(F.coalesce(value("context"), value("relativePath"), path), r"[^A-Za-z0-9._-]+", "-")
    quoted = lambda c: F.coalesce(F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')), F.lit("null"))
    identity = F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), quoted(value(k))) for k in IDENTITY)), F.lit("}"))
    return F.concat(label, F.lit("-"), F.sha2(identity, 256))


def container_records(bindings: DataFrame, aliases: DataFrame, contextual: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records (scope, abstract, concrete, confidence) of a container, and diagnostics (abstract, reason) of what it cannot tell.

    bindings: (abstract, concrete, kind: class, instance, factory or other, confidence); aliases: (alias, abstract); contextual:
    (consumer, abstract, concrete). An alias stands for its abstract's binding; a factory whose product is not known has no
    record; a contextual override counts for its consumer alone.
    """
    known = bindings.where("concrete IS NOT NULL")
    own = known.select(F.lit("default").alias("scope"), "abstract", "concrete", "confidence")
    of_alias = aliases.join(known, "abstract").select(F.lit("default").alias("scope"), F.col("alias").alias("abstract"), "concrete", "confidence")
    alone = aliases.join(bindings, "abstract", "left_anti").select(F.lit("default").alias("scope"), F.col("alias").alias("abstract"), F.col("abstract").alias("concrete"), F.lit(1.0).alias("confidence"))
    special = contextual.where("concrete IS NOT NULL").select(F.concat(F.lit("contextual:"), "consumer").alias("scope"), "abstract", "concrete", F.lit(0.95).alias("confidence"))
    every = own.unionByName(of_alias).unionByName(alone).unionByName(special)
    best = every.groupBy("scope", "abstract").agg(F.max_by(F.struct("concrete", "confidence"), F.struct("confidence", "concrete")).alias("x")).select("scope", "abstract", "x.*")
    unknown = bindings.where("concrete IS NULL").select("abstract", F.when(F.col("kind") == "factory", "factory_target_unknown").otherwise("binding_target_unknown").alias("reason"))
    return best, unknown


def to_parse(sources: DataFrame, parsed: DataFrame, parser: str) -> tuple[DataFrame, DataFrame]:
    """Sources (path, text) with the key of their parse, and those whose key is not yet among the parsed (key), each text once.

    The key is a hash of the parser's identity and the text's hash, so a changed text or parser is parsed anew.
    """
    keyed = sources.withColumn("hash", F.sha2("text", 256)).withColumn("key", F.sha2(F.concat(F.sha2(F.lit(parser), 256), F.lit("\0"), "hash"), 256))
    new = keyed.groupBy("key").agg(F.min_by(F.struct("path", "text"), "path").alias("x")).select("key", "x.*").join(parsed.select("key"), "key", "left_anti")
    return keyed.select("path", "hash", "key"), new


def run_scanners(spark: SparkSession, scanners: dict[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Results of the scanners that succeed, written, and warnings (scanner, class, message) of those that do not."""
    done, warnings = {}, []
    for name, scan in scanners.items():
        try:
            done[name] = written(scan(), f"scan-{name}")
        except Exception as e:  # any failure of one scanner leaves the others
            warnings.append((name, type(e).__name__, str(e).encode()[:MESSAGE_BYTES].decode(errors="ignore")))
    return done, spark.createDataFrame(warnings, "scanner string, class string, message string")


# events of a running application --------------------------------------------------------------------------------------------


def in_project(path: Column, root: str, excluded: list[str]) -> Column:
    """Whether a file belongs to the project below root and to none of the excluded paths, given relative to it."""
    own = text.normal_path(path, root)
    gone = F.lit(False)
    for x in excluded:
        gone = gone | (own == x.strip("/")) | own.startswith(x.strip("/") + "/")
    return F.coalesce(own.isNotNull() & (own != "") & ~gone, F.lit(False))


def executed_lines(trace: Column, own_driver: Column) -> Column:
    """Sorted lines of a coverage trace array<struct<line,count>> that ran. Null, not empty, where the driver gave nothing.

    A driver that reports only lines that ran (own_driver) says nothing by an empty trace.
    """
    lines = F.array_sort(F.array_distinct(F.transform(F.filter(trace, lambda x: x["count"] > 0), lambda x: x["line"])))
    return F.when(trace.isNull() | (own_driver & (F.size(lines) == 0)), F.lit(None)).otherwise(lines)


def touched_tables(events: DataFrame) -> DataFrame:
    """(test, tables): the tables that each test's queries name. events: (test, sql)."""
    each = events.select("test", F.explode(text.tables_in_sql(F.col("sql"))).alias("t"))
    return each.groupBy("test").agg(F.array_sort(F.collect_set("t")).alias("tables"))


def rendered_templates(events: DataFrame, root: str, excluded: list[str] = ()) -> DataFrame:
    """(test, templates): the project's templates that each test rendered. events: (test, path)."""
    own = events.where(in_project(F.col("path"), root, list(excluded))).select("test", text.normal_path(F.col("path"), root).alias("t"))
    return own.groupBy("test").agg(F.array_sort(F.collect_set("t")).alias("templates"))
