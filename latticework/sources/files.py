"""Source files as tables: discovery, hashes, templates, references in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.functions import text


def find_files(spark: SparkSession, directories: list[str], extensions: tuple[str, ...]) -> DataFrame:
    """(path, text, hash) of the files below some directories with one of the extensions (in any case), each once."""
    pattern = "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(directories)
    return raw.select(F.col("path"), F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("hash")).dropDuplicates(["path"])


def views(files: DataFrame, roots: DataFrame, suffix: str = ".blade.php") -> DataFrame:
    """(name, path): templates by dotted name; of equal names the one below the earliest root. roots: (root, ordinal).

    The folders above each file are exploded, so that roots are found by an equi-join.
    """
    folders = F.split("path", "/")
    above = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(folders) - 1, F.lit(1))), lambda i: F.array_join(F.slice(folders, 1, i), "/"))).alias("root"))
    under = above.join(roots, "root").where(F.col("path").startswith(F.concat(F.col("root"), F.lit("/"))))
    local = F.expr("substring(path, length(root) + 2)")
    rows = under.select("path", "ordinal", local.alias("local")).where(F.col("local").endswith(suffix) & ~F.col("local").rlike(r"(^|/)[^/]*\.[^/]*/"))
    named = rows.withColumn("name", F.replace(F.expr(f"left(local, length(local) - {len(suffix)})"), F.lit("/"), F.lit(".")))
    return named.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("ordinal", "path"))).where("k = 1").select("name", "path")


def template_edges(templates: DataFrame) -> DataFrame:
    """(src, dst, type, confidence): templates that others name in directives or tags, if these exist; others are diagnostics."""
    found = templates.select("name", F.explode(text.view_names(text.masked_template(F.col("source")))).alias("r")).select(F.col("name").alias("src"), "r.kind", F.col("r.name").alias("target"), "r.confidence")
    known = templates.select(F.col("name").alias("target")).distinct()
    best = found.join(known, "target", "left_semi").groupBy("src", "target", "kind").agg(F.max("confidence").alias("confidence"))
    return best.select(F.concat(F.lit("view:"), "src").alias("src"), F.concat(F.lit("view:"), "target").alias("dst"), F.col("kind").alias("type"), "confidence")


def missing_templates(templates: DataFrame) -> DataFrame:
    """(src, target): templates that are named and do not exist."""
    found = templates.select("name", F.explode(text.view_names(text.masked_template(F.col("source")))).alias("r")).select(F.col("name").alias("src"), F.col("r.name").alias("target"))
    return found.join(templates.select(F.col("name").alias("target")), "target", "left_anti").distinct()


def route_references(sources: DataFrame, routes: DataFrame) -> DataFrame:
    """(src, dst, confidence): routes consumed by name, at 0.98. sources: (id, source); routes: (id, name)."""
    named = sources.select(F.col("id").alias("src"), F.explode(F.array_distinct(text.route_names(F.col("source")))).alias("name"))
    return named.join(routes.select(F.col("id").alias("dst"), "name"), "name").select("src", "dst", F.lit(0.98).alias("confidence"))


def literal_matches(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """(call, route, certainty, candidates, confidence): routes that literal URLs of calls may reach.

    calls: (call, method, url); routes: (route, method, uri, domain). A call without a host cannot tell routes with a domain.
    Exact at 0.9, else possible at 0.55. Routes and paths are joined on the method, the number of segments (optional ones give
    a route several) and the first segment if it is literal, and then compared by pattern.
    """
    host = F.nullif(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/:?#]+)", 1), F.lit(""))
    c = text.with_segments(calls.select("call", "method", text.path_of(F.col("url")).alias("path"), host.alias("host")), "path")
    r = text.with_shapes(routes, "uri").select("route", "method", "segments", "head", text.uri_pattern(F.col("uri")).alias("pattern"), "domain", F.regexp_replace(F.regexp_replace(F.coalesce("domain", F.lit("")), r"([.+*()\[\]^$|\\])", r"\\$1"), r"\{\w+\}", "[^.]+").alias("domain_pattern"))
    hit = F.expr("path RLIKE pattern") & (F.col("host").isNull() | F.col("domain").isNull() | F.expr("host RLIKE concat('^', domain_pattern, '$')"))
    each = text.shape_join(c, r, ["method"]).where(hit).withColumn("candidates", F.count("*").over(Window.partitionBy("call"))).withColumn("bound", F.max(F.col("host").isNull() & F.col("domain").isNotNull()).over(Window.partitionBy("call")))
    possible = (F.col("candidates") > 1) | F.col("bound")
    return each.select("call", "route", F.when(possible, "possible").otherwise("exact").alias("certainty"), "candidates", F.when(possible, 0.55).otherwise(0.9).alias("confidence"))


#: Bytes of a directive's arguments that are read at most.
DIRECTIVE_SPAN = 16_384


def directive_arguments(source: str, opened: int) -> list[str] | None:
    """Arguments between the bracket at a place and the one that closes it; None if it is not closed within the span.

    Commas inside quotes and inner brackets do not divide; a backslash in quotes takes the next character along.
    """
    out, depth, quote, current, i = [], 0, None, [], opened
    end = min(len(source), opened + DIRECTIVE_SPAN)
    while i < end:
        c = source[i]
        if quote:
            current.append(c)
            if c == "\\" and i + 1 < len(source):
                i += 1
                current.append(source[i])
            elif c == quote:
                quote = None
        elif c in "'\"":
            quote = c
            current.append(c)
        elif c in "([{":
            depth += 1
            if depth > 1 or c != "(":
                current.append(c)
        elif c in ")]}":
            depth -= 1
            if not depth:
                return [*out, "".join(current).strip()]
            current.append(c)
        elif c == "," and depth == 1:
            out.append("".join(current).strip())
            current = []
        else:
            current.append(c)
        i += 1
    return None


def directives(templates: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(name, directive, arguments) of the directives of templates (name, source), outside of comments; a lexer, so not SQL."""
    import re

    import pandas as pd

    from latticework.runtime import ship

    ship(templates.sparkSession)
    pattern = re.compile(r"@(" + "|".join(map(re.escape, names)) + r")\s*\(")

    def run(frames):
        for f in frames:
            rows = [(name, m.group(1), args) for name, source in zip(f["name"], f["source"], strict=True) for m in pattern.finditer(source or "") if (args := directive_arguments(source, m.end() - 1)) is not None]
            yield pd.DataFrame(rows, columns=["name", "directive", "arguments"])

    return templates.select("name", text.masked_template(F.col("source")).alias("source")).mapInPandas(run, "name string, directive string, arguments array<string>")


def include_first(found: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst, type, confidence, certainty) to every literal candidate of first-of includes, and the names of templates whose list is computed.

    found: (name, arguments), the first argument being the list; known: (name), templates that exist.
    """
    first = F.get("arguments", F.lit(0))
    rows = found.withColumn("list", F.coalesce(first, F.lit("")))
    literal = F.transform(F.concat(F.regexp_extract_all("list", F.lit(r"'((?:\\.|[^'\\])*)'"), F.lit(1)), F.regexp_extract_all("list", F.lit(r'"((?:\\.|[^"\\])*)"'), F.lit(1))), lambda x: x)
    each = rows.where("list LIKE '[%'").select("name", F.explode(F.array_distinct(literal)).alias("target"))
    edges = each.join(known.select(F.col("name").alias("target")).distinct(), "target", "left_semi")
    return edges.select(F.concat(F.lit("view:"), "name").alias("src"), F.concat(F.lit("view:"), "target").alias("dst"), F.lit("includes").alias("type"), F.lit(0.7).alias("confidence"), F.lit("possible").alias("certainty")).distinct(), rows.where("NOT list LIKE '[%'").select("name").distinct()
