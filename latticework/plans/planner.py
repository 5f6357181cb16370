"""Task seeds, context scores and reading plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework import schema
from latticework.functions import text
from latticework.operators import traverse
from latticework.runtime import written

#: Weight of a match by the field it is in, exact or partial (fixed values).
WEIGHTS = {"id": (1.0, 0.8), "name": (0.98, 0.78), "label": (0.95, 0.70), "file": (0.6, 0.6)}
SEEDS = 24
#: Weight of a node type in a context's score (fixed values).
ROLE_WEIGHT = {"route": 0.95, "method": 0.95, "form_request": 0.90, "test": 0.90, "model": 0.85, "event": 0.85, "job": 0.85, "view": 0.85, "table": 0.70, "column": 0.70, "cache": 0.70, "filesystem": 0.70, "external": 0.70}
ROLE_OTHER = 0.80


def match_weights(nodes: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, term, weight): the best weight of each term of a task in each node that has it.

    A node's words are exploded and joined on the term, so only matches are made; the task's terms are a few dozen.
    """
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit("")).alias("value")) for f in WEIGHTS])
    each = nodes.select("id", F.explode(fields).alias("x")).select("id", "x.field", F.explode(F.array_distinct(F.transform(text.words(F.col("x.value")), text.stem))).alias("term"), (F.size(text.words(F.col("x.value"))) == 1).alias("whole"))
    weight = F.lit(0.0)
    for f, (exact, part) in WEIGHTS.items():
        weight = F.when((F.col("field") == f) & F.col("whole"), exact).when(F.col("field") == f, part).otherwise(weight)
    return each.join(F.broadcast(terms), "term").groupBy("id", "term").agg(F.max(weight).alias("weight"))


def lexical_seeds(nodes: DataFrame, task: Column | str, limit: int = SEEDS) -> DataFrame:
    """(id, relevance): seeds whose words cover the task's terms, weighted by their rarity among all nodes.

    idf = ln((N + 1) / (df + 1)) + 1; relevance = min(0.9, 0.55 + 0.35 * covered).
    """
    spark = nodes.sparkSession
    task = F.lit(task) if isinstance(task, str) else task
    terms = spark.range(1).select(F.explode(text.terms(task)).alias("term"))
    # only nodes that have a term, with a few numbers each
    found = written(match_weights(nodes, terms), "matches")
    total = nodes.agg(F.count("*").alias("n"))
    # at most 64 terms
    df = terms.join(found.groupBy("term").agg(F.count("*").alias("df")), "term", "left").join(F.broadcast(total)).select("term", (F.ln((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1).alias("idf"))
    whole = df.agg(F.sum("idf").alias("whole"))
    scored = found.join(F.broadcast(df), "term").groupBy("id").agg(F.sum(F.col("weight") * F.col("idf")).alias("s")).join(F.broadcast(whole))
    relevance = F.least(F.lit(0.90), F.lit(0.55) + 0.35 * F.col("s") / F.col("whole"))
    return scored.select("id", F.round(relevance, 6).alias("relevance")).orderBy(F.desc("relevance"), "id").limit(limit)


def rank_of(column: Column, table: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def merge_seeds(seeds: DataFrame) -> DataFrame:
    """One seed for each node: the greatest relevance, the best source, all sources and terms."""
    rank = rank_of(F.col("source"), schema.SEED_SOURCE, 4)
    return seeds.groupBy("id").agg(F.max("relevance").alias("relevance"), F.min(rank).alias("source_rank"), F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms"))


def ordered_seeds(seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    """By (source, relevance falling, node type, file, line with nulls last, id)."""
    rows = seeds.join(nodes.select("id", "type", "file", "line"), "id")
    return rows.orderBy("source_rank", F.desc("relevance"), rank_of(F.col("type"), schema.SEED_TYPE, 6), F.coalesce("file", F.lit("")), F.asc_nulls_last("line"), "id")


def context_score(kind: Column, confidence: Column, depth: Column, evidence: Column) -> Column:
    """min(1, confidence * 0.9^depth * weight of the role * (1 + 0.02 * min(3, evidence)))."""
    weight = F.lit(ROLE_OTHER)
    for k, w in ROLE_WEIGHT.items():
        weight = F.when(kind == k, w).otherwise(weight)
    return F.least(F.lit(1.0), confidence.cast("double") * F.pow(F.lit(0.9), depth) * weight * (1 + 0.02 * F.least(F.lit(3), evidence)))


def expand(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 2, least: float = 0.0) -> DataFrame:
    """(id, type, direction, depth, confidence, score): seeds with what lies downstream and upstream, the best context of each node."""

    def walk(direction: str, rules: dict, other: tuple[str, ...] | None) -> DataFrame:
        steps = written(traverse._ruled(traverse.directed(edges, tuple(sorted({t for v in rules.values() for t in v} | set(other or ()))), direction), nodes, rules, other), "steps")
        by_depth = traverse.levels(seeds.select("id", F.col("relevance").alias("confidence")), steps, depth, least)
        return traverse.best_hits(traverse._union(by_depth[1:]))

    own = seeds.select("id", F.lit("seed").alias("direction"), F.lit(0).alias("depth"), F.col("relevance").cast(schema.PATH_CONFIDENCE).alias("confidence"))
    hits = own
    for name, direction, rules, other in (("downstream", "out", schema.DOWNSTREAM, None), ("upstream", "in", schema.UPSTREAM, schema.UPSTREAM_OTHER)):
        hits = hits.unionByName(walk(direction, rules, other).select(F.col("node").alias("id"), F.lit(name).alias("direction"), "depth", "confidence"))
    rows = hits.join(nodes.select("id", "type"), "id").withColumn("score", F.round(context_score(F.col("type"), F.col("confidence"), F.col("depth"), F.lit(0)), 6))
    order = Window.partitionBy("id").orderBy(F.desc("score"), rank_of(F.col("direction"), schema.DIRECTION, 3), "depth")
    return rows.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def read_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, read_rank): the least rank over the roles of a node's incoming edges, else that of its type."""
    role = rank_of(F.col("type"), schema.READ_ROLE, 99)
    of_edges = edges.where(F.col("type").isin(*schema.READ_ROLE)).groupBy(F.col("dst").alias("id")).agg(F.min(role).alias("role"))
    return nodes.select("id", "type").join(of_edges, "id", "left").select("id", F.coalesce("role", rank_of(F.col("type"), schema.READ_TYPE, schema.READ_OTHER)).alias("read_rank"))


def mapped_tests(contexts: DataFrame, edges: DataFrame, limit: int = 32) -> DataFrame:
    """(test, confidence, routes): tests of the routes and methods in context, the strongest link of each."""
    links = edges.where(F.col("type").isin("tests_route", "runtime_covers")).join(contexts.select(F.col("id").alias("dst")), "dst", "left_semi")
    return links.groupBy(F.col("src").alias("test")).agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("dst")).alias("routes")).orderBy(F.desc("confidence"), "test").limit(limit)


def gaps(uncertainties: DataFrame) -> DataFrame:
    """(code, n, location): uncertainties by code, with the first location."""
    return uncertainties.groupBy("code").agg(F.sum("n").alias("n"), F.min("location").alias("location"))


def bounded_uncertainties(rows: DataFrame, limit: int = 50) -> DataFrame:
    """Distinct uncertainties in order, limited, each with the number of its reason before the limit."""
    distinct = rows.distinct().withColumn("of_reason", F.count("*").over(Window.partitionBy("reason")))
    return distinct.orderBy("reason", "subject").limit(limit)


def candidate_files(candidates: DataFrame, limit: int = 32) -> DataFrame:
    """(file, priority, relevance): the first files by (least priority, greatest relevance, path)."""
    return candidates.groupBy("file").agg(F.min("priority").alias("priority"), F.max("relevance").alias("relevance")).orderBy("priority", F.desc("relevance"), "file").limit(limit)


def changed_file_nodes(nodes: DataFrame, matches: DataFrame, file: str, limit: int = 16) -> DataFrame:
    """(id, relevance): nodes of a changed file: half of the limit by their match weights, the rest evenly spaced over the file."""
    from latticework.operators import index

    own = nodes.where(F.col("file") == file)
    score = matches.groupBy("id").agg(F.sum("weight").alias("score"))
    best = own.join(score, "id").orderBy(F.desc("score"), F.asc_nulls_last("line"), "id").limit(limit // 2).select("id")
    spaced = index.sampled_in_file(own.join(best, "id", "left_anti"), file, limit - limit // 2).select("id")
    return best.unionByName(spaced).select("id", F.lit(0.98).alias("relevance"))


def identifier_seeds(nodes: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(id, relevance): nodes that an identifier of the task names, in any case, by id, label, name or last part of the id."""
    keys = F.array_distinct(F.array_compact(F.array(F.lower("id"), F.lower("label"), F.lower("name"), F.lower(F.element_at(F.split("id", r"::|\\\\|:"), -1)))))
    return nodes.select("id", F.explode(keys).alias("term")).join(F.broadcast(identifiers), "term", "left_semi").select("id").distinct().withColumn("relevance", F.lit(0.92))


def discover(nodes: DataFrame, task: str, targets: DataFrame, files: list[str], limit: int = SEEDS) -> DataFrame:
    """Seeds of a task: explicit targets (id) at 1, nodes of changed files at 0.98, named identifiers at 0.92, and lexical ones."""
    spark = nodes.sparkSession
    none = F.array().cast("array<string>")
    rows = targets.select("id", F.lit(1.0).alias("relevance"), F.lit("explicit").alias("source"), none.alias("terms"))
    terms = spark.range(1).select(F.explode(text.terms(F.lit(task))).alias("term"))
    matches = match_weights(nodes, terms)
    for f in files:
        rows = rows.unionByName(changed_file_nodes(nodes, matches, f).select("id", "relevance", F.lit("changed_file").alias("source"), none.alias("terms")))
    identifiers = spark.range(1).select(F.explode(text.identifiers(F.lit(task))).alias("term"))
    rows = rows.unionByName(identifier_seeds(nodes, identifiers).select("id", "relevance", F.lit("identifier").alias("source"), none.alias("terms")))
    rows = rows.unionByName(lexical_seeds(nodes, task).join(matches.groupBy("id").agg(F.array_sort(F.collect_set("term")).alias("terms")), "id").select("id", "relevance", F.lit("lexical").alias("source"), "terms"))
    return ordered_seeds(merge_seeds(rows), nodes).limit(limit)


def table_contexts(accesses: DataFrame, table: str, field: str | None) -> DataFrame:
    """(caller, tier, rank): readers and writers of a table or column seed, proven before possible before structural."""
    from latticework.operators.classify import classify

    verdict = classify(F.col("operations"), F.lit(field), F.lit(table), 256) if field else F.lit("structural")
    rows = accesses.where(F.col("tbl") == table).select("caller", verdict.alias("tier")).where("tier <> 'excluded'")
    rank = F.when(F.col("tier") == "proven", 0).when(F.col("tier") == "possible", 1).otherwise(2)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("tier").orderBy("caller"))).orderBy(rank, "caller")


def shown_paths(hits: DataFrame, limit: int = 32, evidence: int = 64) -> DataFrame:
    """The best paths, each (direction, path) once, as long as their evidence records fit the budget altogether."""
    best = hits.withColumn("k", F.row_number().over(Window.partitionBy("direction", "path").orderBy(F.desc("confidence"), "depth"))).where("k = 1").drop("k")
    top = best.orderBy(F.desc("confidence"), "depth", "path").limit(limit)
    spent = F.sum(F.greatest(F.col("evidence"), F.lit(0))).over(Window.orderBy(F.desc("confidence"), "depth", "path").rowsBetween(Window.unboundedPreceding, 0))  # of a few rows
    return top.withColumn("spent", spent).where(F.col("spent") <= evidence)


def span_candidates(contexts: DataFrame, nodes: DataFrame, tests: DataFrame, files: list[str]) -> DataFrame:
    """(file, start, end, priority, relevance): where to read: contexts, tests at 0.85 of their confidence, changed files at 1."""
    spark = nodes.sparkSession
    place = nodes.select("id", "file", F.col("line").alias("start"), F.col("end_line").alias("end")).where("file IS NOT NULL")
    own = contexts.join(place, "id").select("file", "start", "end", F.when(F.col("direction") == "seed", 0).otherwise(2).alias("priority"), F.col("score").alias("relevance"))
    of_tests = tests.join(place, F.col("test") == F.col("id")).select("file", "start", "end", F.lit(2).alias("priority"), (F.col("confidence").cast("double") * 0.85).alias("relevance"))
    changed = spark.createDataFrame([(f, None, None, 1, 1.0) for f in files], "file string, start int, end int, priority int, relevance double")
    vendor = F.col("file").rlike(r"(^|/)(vendor|node_modules)/")
    return own.unionByName(of_tests).unionByName(changed).where(~vendor)


def plan(nodes: DataFrame, edges: DataFrame, sources: dict[str, list[str]], task: str = "", targets: list[str] = (), files: list[str] = (), budget: int = 4000, depth: int = 2) -> dict:
    """A reading plan: seeds, contexts, tests to run, and the spans that fit the budget. Sources: lines by file, of one project."""
    from latticework.plans.packing import Candidate, pack

    spark = nodes.sparkSession
    explicit = spark.createDataFrame([(t,) for t in targets], "id string").join(nodes.select("id"), "id", "left_semi")
    seeds = discover(nodes, task, explicit, list(files))
    # at most 24 seeds: taken once, so that the walks below start from rows
    chosen = spark.createDataFrame([(r["id"], r["relevance"]) for r in seeds.collect()], "id string, relevance double")
    contexts = written(expand(chosen, nodes, edges, depth), "contexts")
    tests = mapped_tests(contexts, edges)
    rows = span_candidates(contexts, nodes, tests, list(files)).orderBy("priority", F.desc("relevance"), "file").limit(512).collect()
    spans, left_out = pack([Candidate(r["file"], r["start"], r["end"], r["priority"], r["relevance"]) for r in rows], sources, budget)
    first = contexts.orderBy(F.desc("score"), "id").limit(64)
    shown = first.collect()
    order = {r["id"]: r["read_rank"] for r in read_order(nodes.join(first.select("id"), "id", "left_semi"), edges).collect()}
    return {
        "contexts": [{"id": r["id"], "direction": r["direction"], "score": r["score"], "read": order.get(r["id"], schema.READ_OTHER)} for r in shown],
        "tests": [r["test"] for r in tests.collect()], "spans": [{"file": f, "start": a, "end": b, "tokens": n} for f, a, b, n in spans], "omittedSpans": left_out,
    }


def call_uncertainties(contexts: DataFrame, diagnostics: DataFrame, reasons: int = 16) -> DataFrame:
    """(caller, n, reasons, truncated): unresolved calls of the methods in context, by reason: the first reasons by name.

    contexts: (id, type); diagnostics: (caller, reason, n).
    """
    methods = contexts.where("type = 'method'").select(F.col("id").alias("caller")).distinct()
    rows = diagnostics.join(methods, "caller", "left_semi").groupBy("caller", "reason").agg(F.sum("n").alias("n"))
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("caller").orderBy("reason")))
    kept = F.expr(f"collect_list(struct(reason, n)) FILTER (WHERE k <= {reasons})")
    return ranked.groupBy("caller").agg(F.sum("n").alias("n"), F.array_sort(kept).alias("reasons"), (F.max("k") > reasons).alias("truncated"))


def supplemental_tokens(fields: list[Column], values: int = 16, value_bytes: int = 512, limit: int = 128) -> Column:
    """Distinct terms of a node's further fields (signature, summary, selected metadata), given as strings or arrays of strings.

    At most so many values, each cut to so many bytes, and so many terms.
    """
    every = F.filter(F.flatten(F.array(*fields)), lambda v: v.isNotNull())
    cut = F.transform(F.slice(every, 1, values), lambda v: text.truncate_bytes(v, value_bytes))
    return F.slice(F.array_distinct(F.flatten(F.transform(cut, lambda v: text.terms(v, limit)))), 1, limit)
