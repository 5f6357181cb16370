"""Runtime observations: line ranges, freshness, merging of captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework import schema
from latticework.runtime import written


def line_ranges(lines: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """(keys, start, end): maximal runs of consecutive lines (gaps and islands)."""
    order = Window.partitionBy(*keys).orderBy(line)
    rows = lines.select(*keys, line).distinct().withColumn("island", F.col(line) - F.row_number().over(order))
    return rows.groupBy(*keys, "island").agg(F.min(line).alias("start"), F.max(line).alias("end")).drop("island")


def merge_ranges(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end): ranges that overlap or touch as one."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = ranges.withColumn("fresh", F.coalesce(F.col("start") > reached + 1, F.lit(True)).cast("int")).withColumn("island", F.sum("fresh").over(order))
    return rows.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def overlaps(ranges: DataFrame, spans: DataFrame, key: str, width: int = 256, keep: str | None = None) -> DataFrame:
    """Ranges cut to the spans of the same key that they meet: (key, id, start, end), and keep of the range, if given.

    Both are dealt to tiles of so many lines, so that the join is an equi-join on (key, tile); a pair counts in the first
    tile it shares. Long ranges cost a row a tile.
    """
    tiles = lambda df, s, e: df.withColumn("tile_", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width))))
    also = [keep] if keep else []
    r = tiles(ranges.select(F.col(key).alias("key_"), F.col("start").alias("rs_"), F.col("end").alias("re_"), *also), "rs_", "re_").withColumnRenamed("tile_", "rt_")
    s = tiles(spans.select(F.col(key).alias("own_"), F.col("id").alias("id_"), F.col("start").alias("ss_"), F.col("end").alias("se_")), "ss_", "se_")
    j = s.join(r, (F.col("own_") == F.col("key_")) & (F.col("tile_") == F.col("rt_")))
    first = F.floor(F.greatest("rs_", "ss_") / width)
    met = j.where((F.col("rs_") <= F.col("se_")) & (F.col("re_") >= F.col("ss_")) & (F.col("tile_") == first))
    return met.select(F.col("own_").alias(key), F.col("id_").alias("id"), F.greatest("rs_", "ss_").alias("start"), F.least("re_", "se_").alias("end"), *also)


def freshness(expected: Column, current: Column, known: Column) -> Column:
    """missing without a current file, unverified without an expected hash, else verified or stale."""
    return F.when(~known, "missing").when(expected.isNull(), "unverified").when(expected == current, "verified").otherwise("stale")


def worst(state: Column) -> Column:
    """Of states in a group, the worst: missing, stale, unverified, verified."""
    rank = F.lit(0)
    for i, s in enumerate(schema.FRESHNESS):
        rank = F.when(state == s, i).otherwise(rank)
    return F.get(F.array(*map(F.lit, schema.FRESHNESS)), F.max(rank))


def buckets(edges: DataFrame, keep: int = 32) -> DataFrame:
    """(src, dst, type, one count for each freshness, observations, state): observed edges put together.

    state: the one freshness there is, else mixed. Stale and missing ones are counted, not kept as observations.
    """
    counts = [F.count_if(F.col("freshness") == s).alias(s) for s in schema.FRESHNESS]
    seen = F.slice(F.array_sort(F.collect_set(F.when(F.col("freshness").isin("verified", "unverified"), F.col("observation")))), 1, keep).alias("observations")
    rows = edges.groupBy("src", "dst", "type").agg(*counts, seen)
    kinds = sum((F.col(s) > 0).cast("int") for s in schema.FRESHNESS)
    only = F.coalesce(*[F.when(F.col(s) > 0, F.lit(s)) for s in schema.FRESHNESS])
    return rows.withColumn("state", F.when(kinds == 1, only).when(kinds > 1, "mixed").otherwise("unknown"))


def edge_confidence(verified: Column) -> Column:
    """1 with a verified observation, else 0.7."""
    return F.when(verified > 0, 1.0).otherwise(0.7)


def latest(observations: DataFrame, keys: list[str], captured: str, session: str, values: str) -> DataFrame:
    """Of each key, the observations of the last capture (of equal times, the greater session), their values as one set."""
    rows = observations.withColumn("best", F.max(F.struct(captured, session)).over(Window.partitionBy(*keys)))
    kept = rows.where((F.col(captured) == F.col("best")[captured]) & (F.col(session) == F.col("best")[session]))
    return kept.groupBy(*keys, captured, session).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(values)))).alias(values))


def one_hash(hash: str) -> Column:
    """The hash that all rows of a group agree on, else null."""
    return F.when(F.count_distinct(hash) == 1, F.max(hash))


def coverage_by_test(coverage: DataFrame) -> DataFrame:
    """(test, file, lines): coverage given by file and line, turned to tests."""
    rows = coverage.select("file", "line", F.explode("tests").alias("test"))
    return rows.groupBy("test", "file").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def finished_only(observations: DataFrame, events: DataFrame) -> DataFrame:
    """Observations of tests that came to their end; those of aborted tests go."""
    return observations.join(events.where("kind = 'finished'").select("session", "test").distinct(), ["session", "test"], "left_semi")


def capped(observations: DataFrame, per_test: int) -> DataFrame:
    """The first sources of each test: templates before other files, then by path."""
    order = Window.partitionBy("test").orderBy(F.desc("is_template"), "file")
    return observations.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_test).drop("rank")


# import of captures ---------------------------------------------------------------------------------------------------------

CAPTURE = "test string, file string, sha256 string, session string, captured_at long, sources array<struct<file:string,sha256:string,ranges:array<array<int>>>>, tables array<string>, components array<string>"


def read_captures(spark, path: str) -> DataFrame:
    """Captured tests from JSON lines, of this layout or not at all."""
    return spark.read.schema(CAPTURE).option("mode", "FAILFAST").json(path)


def captured_sources(captures: DataFrame) -> DataFrame:
    """(test, test_file, session, captured_at, file, sha256, start, end): executed ranges of each test; malformed ranges are left out."""
    each = captures.select("test", F.col("file").alias("test_file"), "session", "captured_at", F.explode("sources").alias("s"))
    ranges = each.select("test", "test_file", "session", "captured_at", F.col("s.file").alias("file"), F.col("s.sha256").alias("sha256"), F.explode("s.ranges").alias("r"))
    return ranges.where("size(r) = 2 AND r[0] >= 1 AND r[1] >= r[0]").select("test", "test_file", "session", "captured_at", "file", "sha256", F.col("r")[0].alias("start"), F.col("r")[1].alias("end"))


def observed_edges(captures: DataFrame, manifest: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst, type, freshness, observation, confidence-ready): what tests were seen to execute.

    File by file at the freshness of its hash against the manifest (path, hash), and symbol by symbol (id, file, start, end)
    where an executed range meets the symbol's span. Captures of a test that are older than its last do not count.
    Captures are dealt by test once, ranges as numbers, and where symbols that meet and manifest are small, the edges come
    about there: neither they nor import_edges() need another shuffle.
    """
    spans = captured_sources(captures).select("file", "start", "end").distinct()  # tests share them, so symbols meet each once
    met = overlaps(spans.withColumn("span", F.struct("start", "end")), symbols, "file", keep="span").select("file", "span.start", "span.end", "id").distinct()
    met = written(met, "met").withColumn("is_met", F.lit(True))
    good = lambda r: (F.size(r) == 2) & (r[0] >= 1) & (r[1] >= r[0])
    packed = lambda r: F.shiftleft(r[0].cast("long"), 32).bitwiseOR(r[1].cast("long"))
    item = "struct<touches:boolean,name:string,sha256:string,ranges:array<bigint>>"
    of_sources = F.transform("sources", lambda s: F.struct(F.lit(False), s["file"], s["sha256"], F.transform(F.filter(s["ranges"], good), packed)).cast(item))
    of_tables = F.transform("tables", lambda t: F.struct(F.lit(True), t, F.lit(None), F.lit(None)).cast(item))
    none = F.array().cast(f"array<{item}>")
    items = F.concat(F.coalesce(of_sources, none), F.coalesce(of_tables, none)).alias("items")
    dealt = captures.where("test IS NOT NULL").select(F.concat(F.lit("test:"), "test").alias("src"), "test", "session", "captured_at", items)
    now = dealt.withColumn("k", F.max(F.struct("captured_at", "session")).over(Window.partitionBy("src"))).where("captured_at = k.captured_at AND session = k.session")
    each = now.select("src", F.concat_ws("#", "session", "test").alias("observation"), F.explode("items").alias("i")).select("src", "observation", "i.*").withColumn("file", F.when(~F.col("touches"), F.col("name")))
    rows = each.join(manifest.select(F.col("path").alias("file"), F.col("hash").alias("current")), "file", "left")
    state = F.when(F.col("touches"), "unverified").otherwise(freshness(F.col("sha256"), F.col("current"), F.col("current").isNotNull()))
    rows = rows.select("src", "observation", "touches", "name", "file", state.alias("freshness"), F.posexplode_outer("ranges").alias("pos", "range")).where("touches OR pos IS NOT NULL")
    rows = rows.withColumns({"start": F.shiftright("range", 32).cast("int"), "end": F.col("range").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")}).join(met, ["file", "start", "end"], "left")
    # a file counts with its first range; a struct more than the edges there are is left out
    whole = F.struct(F.lit(True).alias("is_met"), F.concat(F.when(F.col("touches"), "table:").otherwise("source_file:"), "name").alias("dst"))
    symbol = F.struct("is_met", F.col("id").alias("dst"))
    ends = F.when(F.col("touches"), F.array(whole)).when(F.col("pos") == 0, F.array(whole, symbol)).otherwise(F.array(symbol))
    kind = F.when(F.col("touches"), "runtime_touches_table").otherwise("runtime_covers").alias("type")
    return rows.select("src", kind, "freshness", "observation", F.explode(ends).alias("e")).where("e.is_met").select("src", "e.dst", "type", "freshness", "observation").distinct()


def import_edges(observed: DataFrame, keep: int = 32) -> DataFrame:
    """Observed edges put together, without those seen only in stale or missing files, at confidence 1 or 0.7."""
    rows = buckets(observed, keep).where("verified + unverified > 0")
    return rows.withColumn("confidence", edge_confidence(F.col("verified")))


def page_component(response: Column) -> Column:
    """Name of the page component in a response: JSON itself, or page data embedded in a document."""
    embedded = F.replace(F.regexp_extract(response, r'data-page="([^"]*)"', 1), F.lit("&quot;"), F.lit('"'))
    return F.coalesce(F.get_json_object(F.when(F.ltrim(response).startswith("{"), response), "$.component"), F.get_json_object(embedded, "$.component"))
