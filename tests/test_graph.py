"""The engine on the small graph, and traversals against a queue-driven search on random graphs."""

import heapq
import random
from decimal import ROUND_HALF_UP, Decimal

import graphs
import pytest
from pyspark.sql import functions as F

from latticework import schema
from latticework.functions import limits, text
from latticework.operators import classify, diff, engine, index, merge, observe, store, traverse
from latticework.plans import packing, planner


@pytest.fixture(scope="module")
def g(spark):
    nodes, edges = graphs.frames(spark)
    return nodes.cache(), edges.cache()


def seed(spark, *ids):
    return spark.createDataFrame([(i, Decimal(1)) for i in ids], "id string, confidence decimal(5,4)")


def test_calls_are_ranked_and_cycles_cut(spark, g):
    rows = traverse.traverse(seed(spark, "NoteController::update"), g[1], ("calls",), "out", 4).collect()
    assert sorted((r["node"], r["depth"], float(r["confidence"]), r["truncated"]) for r in rows) == [("NoteService::helper", 2, 0.9, False), ("NoteService::save", 1, 1.0, False)]


def test_depth_and_limit_tell_what_is_left_out(spark, g):
    assert [r["truncated"] for r in traverse.traverse(seed(spark, "NoteController::update"), g[1], ("calls",), "out", 1).collect()] == [True]
    assert [(r["node"], r["truncated"]) for r in traverse.traverse(seed(spark, "NoteController::update"), g[1], ("calls",), "out", 4, limit=1).collect()] == [("NoteService::save", True)]


def test_impact_climbs_by_node_type(spark, g):
    rows = {r["node"]: (r["depth"], float(r["confidence"])) for r in traverse.impact(seed(spark, "column:notes.title"), *g, depth=4).collect()}
    assert rows["table:notes"] == (1, 1.0) and rows["NoteService::save"] == (2, 0.85) and rows["NoteController::index"] == (2, 0.9)
    assert rows["App\\Models\\Note"] == (2, 1.0) and rows["NoteController::update"] == (3, 0.9) and rows["route:PUT:notes/{note}"] == (4, 0.9)
    assert "column:notes.title" not in rows


def reference(edges, start, depth, least):
    """Best paths by a queue of states, each (depth, node) once."""
    adjacent = {}
    for a, b, c in edges:
        adjacent.setdefault(a, []).append((b, c))
    best, queue, seen = {}, [(Decimal(-1), 0, (start,))], set()
    while queue:
        c, d, path = heapq.heappop(queue)
        node = path[-1]
        if (d, node) in seen:
            continue
        seen.add((d, node))
        if node != start and node not in best:
            best[node] = (d, -c, path)
        if d < depth:
            for b, w in adjacent.get(node, []):
                n = (-c * w).quantize(Decimal("0.0001"), ROUND_HALF_UP)
                if b not in path and n >= least:
                    heapq.heappush(queue, (-n, d + 1, (*path, b)))
    return best


def test_level_joins_equal_a_best_first_search(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for k in range(40):
        n = rng.randrange(2, 8)
        mine = {(f"{k}.{rng.randrange(n)}", f"{k}.{rng.randrange(n)}"): Decimal(rng.choice(["1", "0.95", "0.9", "0.85", "0.33", "0.5"])) for _ in range(rng.randrange(1, 18))}
        mine = [(a, b, c) for (a, b), c in mine.items() if a != b]
        rows += [(a, b, "calls", c) for a, b, c in mine]
        want[f"{k}.0"] = reference(mine, f"{k}.0", 4, Decimal("0.2"))
    edges = spark.createDataFrame(rows, "src string, dst string, type string, confidence decimal(9,8)")
    got = {}
    for r in traverse.traverse(seed(spark, *want), edges, ("calls",), "out", 4, 0.2).collect():
        got.setdefault(r["seed"], {})[r["node"]] = (r["depth"], r["confidence"], tuple(r["path"]))
    assert got == {k: v for k, v in want.items() if v}


def test_weighted_sources(spark):
    sources = spark.createDataFrame([("Direct", 1.0, 0, ["D"]), ("Service", 0.8, 1, ["S"]), ("Helper", 0.72, 2, ["H"])], "id string, confidence double, depth int, path array<string>").withColumn("confidence", F.col("confidence").cast("decimal(5,4)"))
    edges = spark.createDataFrame([("Direct", "DM", "uses_model", 0.75), ("Service", "SM", "uses_model", 0.95), ("Helper", "HM", "uses_model", 1.0)], "src string, dst string, type string, confidence double").withColumn("confidence", F.col("confidence").cast("decimal(9,8)"))
    for s in (sources, sources.orderBy(F.desc("id"))):
        assert [(r["src"], float(r["score"])) for r in index.ranked_from_sources(s, edges, ("uses_model",), 2).collect()] == [("Service", 0.76), ("Direct", 0.75)]


def test_resolution(g):
    assert [(r["id"], r["resolved"]) for r in index.resolve(g[0], "Tag").collect()] == [("App\\Models\\Tag", False), ("Other\\Tag", False)]
    assert [(r["id"], r["resolved"]) for r in index.resolve(g[0], "NoteService@save").collect()] == [("NoteService::save", True)]
    assert [(r["id"], r["resolved"]) for r in index.resolve(g[0], "notes").collect()] == [("table:notes", True)]
    assert index.resolve(g[0], "absent").collect() == []
    assert [r["resolved"] for r in index.resolve_anchor(g[0], "table:notes").collect()] == [True]
    assert [r["id"] for r in index.resolve_anchor(g[0], "method:NoteService::save").collect() if r["resolved"]] == ["NoteService::save"]
    assert [r["rank"] for r in index.resolve_historical(g[0], "notecontroller@UPDATE").collect()] == [12]


def test_search_prefers_exact_matches_then_words(g):
    assert [r["id"] for r in index.search(g[0], "tag").collect()][:2] == ["App\\Models\\Tag", "Other\\Tag"]
    assert {r["id"] for r in index.search(g[0], "models note").collect()} == {"App\\Models\\Note"}


def test_cards_and_summaries(g):
    assert len(engine.card(*g, "NoteService::save").collect()) == 4
    note = next(r for r in engine.models(*g).collect() if r["label"] == "Note")
    assert (note["tbl"], note["relationships"]) == ("table:notes", 1)
    tables = {r["id"]: (r["columns"], r["readers"], r["writers"]) for r in engine.tables(*g).collect()}
    assert tables == {"table:notes": (1, 1, 1), "table:tags": (None, None, None)}


def test_flow(spark, g):
    routes = spark.createDataFrame([("route:PUT:notes/{note}",)], "id string")
    methods = engine.flow_methods(*g, routes)
    assert {r["node"].split("::")[-1]: float(r["confidence"]) for r in methods.where("node LIKE '%::%'").collect()}["update"] == 1.0
    assert {(r["group"], r["target"]) for r in engine.flow_related(methods, g[1]).collect()} >= {("models", "App\\Models\\Note")}


def test_merging(spark):
    rows = spark.createDataFrame([("a", "unknown", "a", None, None, None, ["x"], 1), ("a", "method", "A", None, "f", 3, ["y"], 2), ("a", "model", "B", "n", "g", None, ["x"], 3)], "id string, type string, label string, name string, file string, line int, sources array<string>, seq long")
    r = merge.merge_nodes(rows).first()
    assert (r["type"], r["label"], r["name"], r["file"], r["line"], r["sources"]) == ("method", "A", "n", "f", 3, ["x", "y"])


def test_column_access_verdicts(spark):
    ops = "array<struct<operation:string,fields:array<string>,coverage:string>>"
    cases = [([("select", ["title"], "complete")], "proven"), ([("select", ["notes.title->en"], "complete")], "proven"), ([("select", [], "whole_row")], "proven"), ([("update", ["{dynamic}"], "complete")], "possible"), ([("update", [], "unknown")], "possible"), ([("select", ["body"], "complete")], "excluded"), ([], "possible")]
    df = spark.createDataFrame([(i, o) for i, (o, _) in enumerate(cases)], f"i int, operations {ops}")
    got = [r["v"] for r in df.select("i", classify.classify(F.col("operations"), F.lit("title"), F.lit("notes")).alias("v")).orderBy("i").collect()]
    assert got == [v for _, v in cases]
    capped = spark.createDataFrame([([("s", ["body"], "complete")] * 3,)], f"operations {ops}").select(classify.classify(F.col("operations"), F.lit("title"), F.lit("notes"), 2).alias("v")).first()[0]
    assert capped == "possible"


def test_dispatch_needs_the_handlers_role(spark):
    edges = spark.createDataFrame([("a", "e", "dispatches", 1.0, ["event"], None, None), ("e", "l", "handled_by", 1.0, None, "event", None), ("e", "j", "handled_by", 1.0, None, "job", None), ("e", "n", "handled_by", 1.0, None, "event", False)], "src string, dst string, type string, confidence double, roles array<string>, role string, causal boolean")
    assert {r["node"] for r in traverse.dispatched(seed(spark, "a"), edges).collect()} == {"e", "l"}


def test_store_publishes_reuses_prunes_and_finds_damage(spark, g, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    first = s.publish(*g)
    assert s.publish(*g)["id"] == first["id"]
    lower = g[1].withColumn("confidence", (F.col("confidence") * F.lit("0.5").cast("decimal(9,8)")).cast("decimal(9,8)"))
    for k in range(3):
        s.publish(g[0].where(F.col("id") != graphs.NODES[k][0]), lower, retain=2)
    assert [x["id"] for x in s.generations()] == [4, 3]
    nodes, edges = s.load()
    assert (nodes.count(), edges.count()) == (11, 12)
    before, after = s.load(3), s.load(4)
    changes = {(r["kind"], r["identity"]) for r in diff.changes(before, after).collect()}
    assert changes == {("added", graphs.NODES[1][0]), ("removed", graphs.NODES[2][0])}


def test_findings_follow_the_rules(spark, g):
    before = store.node_facts(g[0]), store.edge_facts(g[1])
    after = store.node_facts(g[0].where("type <> 'route'")), store.edge_facts(g[1].where("type NOT IN ('routes_to', 'writes')"))
    found = {(r["code"], r["severity"]) for r in diff.findings(diff.changes(before, after)).collect()}
    assert found == {("route_removed", "high"), ("route_action_removed", "high"), ("write_surface_removed", "medium")}
    moved = store.node_facts(g[0].withColumn("line", F.col("line") + 1))
    assert {r["semantic"] for r in diff.changes(before, (moved, before[1])).collect()} == {False}


def test_ranges(spark):
    lines = spark.createDataFrame([("t", x) for x in (1, 2, 3, 7, 9, 10, 3)], "file string, line int")
    assert sorted((r["start"], r["end"]) for r in observe.line_ranges(lines, ["file"]).collect()) == [(1, 3), (7, 7), (9, 10)]
    ranges = spark.createDataFrame([("t", 1, 4), ("t", 5, 6), ("t", 8, 9), ("t", 2, 3)], "file string, start int, end int")
    assert sorted((r["start"], r["end"]) for r in observe.merge_ranges(ranges, ["file"]).collect()) == [(1, 6), (8, 9)]
    spans = spark.createDataFrame([("t", "s", 3, 8), ("t", "u", 700, 900)], "file string, id string, start int, end int")
    assert sorted((r["id"], r["start"], r["end"]) for r in observe.overlaps(ranges, spans, "file").collect()) == [("s", 3, 3), ("s", 3, 4), ("s", 5, 6), ("s", 8, 8)]


def test_terms(spark):
    got = spark.sql("SELECT 'Refactor the updateNotes queries, stopping failed classes' AS t").select(text.terms(F.col("t"))).first()[0]
    assert got == ["update", "note", "query", "stop", "fail", "classe"]
    cut = spark.createDataFrame([("aé漢b",)], "t string").select(*[text.truncate_bytes(F.col("t"), n) for n in range(1, 8)]).first()
    assert [*cut] == [limits.cut_bytes("aé漢b", n) for n in range(1, 8)]
    tables = spark.createDataFrame([("WITH x AS (SELECT * FROM `Notes`) SELECT 1 FROM x JOIN app.tags t ON 1=1; DELETE FROM information_schema.y",)], "q string").select(text.tables_in_sql(F.col("q"))).first()[0]
    assert tables == ["notes", "tags"]


def test_packing_stays_in_budget():
    sources = {"a": ["x" * 40] * 300, "b": ["y" * 8] * 10}
    spans, left = packing.pack([packing.Candidate("a", 1, 300, 0, 1.0), packing.Candidate("b", None, None, 1, 0.5)], sources, 600)
    assert sum(s[3] for s in spans) <= 600 and spans[0][:2] == ("a", 1) and left <= 1
    assert packing.merge_spans([(1, 10), (11, 20), (150, 260), (205, 300)]) == [(1, 20), (150, 300)]
    assert packing.merge_spans([(1, 150), (100, 260)]) == [(1, 150), (151, 260)]


def test_payloads_are_bounded():
    big = {"rows": [{"id": f"n{i}", "text": "z" * 50_000} for i in range(200)]}
    out = limits.limit(big)
    assert len(limits.encode(out).encode()) <= limits.CEILING and out["truncated"]
    assert limits.limit({"a": 1}) == {"a": 1}
    assert limits.changed_paths({"a": {"b": 1, "c/d": 2}, "l": [1, 2]}, {"a": {"b": 2}, "l": [1]}) == (["/a/b", "/a/c~1d", "/l/1"], False)


def test_planner(spark, g):
    seeds = planner.lexical_seeds(g[0], "save the note title", 3).collect()
    assert seeds and all(0.55 <= r["relevance"] <= 0.9 for r in seeds)
    start = spark.createDataFrame([("table:notes", 1.0)], "id string, relevance double")
    assert {r["id"] for r in planner.expand(start, *g).collect()} == {"table:notes"}  # tables never expand
    assert {r["id"]: r["read_rank"] for r in planner.read_order(*g).collect()}["NoteController::update"] == 40
    assert schema.READ_OTHER == 55
