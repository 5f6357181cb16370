"""Reading plans, imports of captures, and the JSON mirror."""

import hashlib
import json

import graphs
import pytest
from pyspark.sql import functions as F

from latticework.operators import observe
from latticework.plans import planner
from latticework.sources import json_graph


@pytest.fixture(scope="module")
def g(spark):
    return graphs.frames(spark)


def test_plan_reads_what_a_task_names(g):
    sources = {n[4]: [f"line {i} of {n[4]}" for i in range(1, 60)] for n in graphs.NODES if n[4]}
    out = planner.plan(*g, sources, "Change `NoteService::save` and the note title", ["NoteController::update"], ["app/Models/Note.src"], 600)
    ids = {c["id"]: c for c in out["contexts"]}
    assert ids["NoteController::update"]["direction"] == "seed" and ids["NoteController::update"]["read"] == 40 and "NoteService::save" in ids
    assert sum(s["tokens"] for s in out["spans"]) <= 600 and {"app/NoteController.src", "app/Models/Note.src"} <= {s["file"] for s in out["spans"]}
    assert planner.plan(*g, sources)["spans"] == []


def test_seeds_keep_their_best_source(spark, g):
    explicit = spark.createDataFrame([("NoteService::save",)], "id string")
    seeds = planner.discover(g[0], "note save 'tags'", explicit, ["app/NoteService.src"]).collect()
    assert (seeds[0]["id"], seeds[0]["relevance"], seeds[0]["sources"]) == ("NoteService::save", 1.0, ["changed_file", "explicit", "lexical"])
    assert {r["id"]: r["source_rank"] for r in seeds}["table:tags"] == 2


def test_paths_fit_the_evidence_budget(spark):
    hits = spark.createDataFrame([("out", ["a", "b"], 0.9, 1, 40), ("out", ["a", "b"], 0.8, 1, 1), ("out", ["a", "c"], 0.7, 1, 20), ("in", ["a", "d"], 0.6, 1, 30)], "direction string, path array<string>, confidence double, depth int, evidence int")
    assert [r["path"][1] for r in planner.shown_paths(hits).orderBy("spent").collect()] == ["b", "c"]


def test_table_contexts(spark):
    ops = "array<struct<operation:string,fields:array<string>,coverage:string>>"
    rows = [("x", "t", [("s", ["c"], "complete")]), ("y", "t", [("s", [], "unknown")]), ("z", "t", [("s", ["d"], "complete")]), ("w", "u", [("s", ["c"], "complete")])]
    df = spark.createDataFrame(rows, f"caller string, tbl string, operations {ops}")
    assert [(r["caller"], r["tier"]) for r in planner.table_contexts(df, "t", "c").collect()] == [("x", "proven"), ("y", "possible")]


def test_captures_become_edges(spark, g, tmp_path):
    now = hashlib.sha256(b"x").hexdigest()
    rows = [
        {"test": "T::a", "file": "t.src", "session": "s1", "captured_at": 1, "sources": [{"file": "app/NoteService.src", "sha256": now, "ranges": [[1, 40]]}], "tables": ["old"]},
        {"test": "T::a", "file": "t.src", "session": "s2", "captured_at": 2, "sources": [{"file": "app/NoteService.src", "sha256": now, "ranges": [[8, 9], [10, 12], [5]]}, {"file": "gone.src", "ranges": [[1, 2]]}], "tables": ["notes"]},
        {"test": "T::b", "file": "t.src", "session": "s2", "captured_at": 2, "sources": [{"file": "app/NoteService.src", "sha256": "other", "ranges": [[23, 23]]}], "tables": []},
    ]
    (tmp_path / "c.json").write_text("\n".join(map(json.dumps, rows)))
    captures = observe.read_captures(spark, str(tmp_path / "c.json"))
    manifest = spark.createDataFrame([("app/NoteService.src", now)], "path string, hash string")
    symbols = g[0].where("line IS NOT NULL").select("id", "file", F.col("line").alias("start"), F.col("end_line").alias("end"))
    edges = {(r["src"], r["dst"]): (r["state"], r["confidence"]) for r in observe.import_edges(observe.observed_edges(captures, manifest, symbols)).collect()}
    assert edges == {("test:T::a", "source_file:app/NoteService.src"): ("verified", 1.0), ("test:T::a", "NoteService::save"): ("verified", 1.0), ("test:T::a", "table:notes"): ("unverified", 0.7)}


def test_symbols_are_paired_only_with_tests_that_meet_them(spark):
    sources = [{"file": "f", "sha256": "h", "ranges": [[1, 9], [300, 600]]}]
    captures = spark.createDataFrame([(f"t{i}", None, None, "s", 1, sources, [], []) for i in range(200)], observe.CAPTURE)
    symbols = spark.createDataFrame([(f"m{i}", "f", 10 * i, 10 * i + 4) for i in range(1000)], "id string, file string, start int, end int")
    edges = observe.observed_edges(captures, spark.createDataFrame([("f", "h")], "path string, hash string"), symbols)
    met = {(r["src"], r["dst"]) for r in edges.collect() if r["dst"].startswith("m")}
    assert met == {(f"test:t{i}", f"m{j}") for i in range(200) for j in (0, *range(30, 61))}
    assert graphs.most(edges, "Join", "numOutputRows") <= 200 * 32


def test_imported_edges_pair_symbols_only_with_tests_that_meet_them(spark):
    captures = spark.createDataFrame([(f"t{i}", None, None, "s", 1, [{"file": "f", "sha256": "h", "ranges": [[41, 42]]}], [], []) for i in range(200)], observe.CAPTURE)
    symbols = spark.createDataFrame([(f"m{i}", "f", 10 * i, 10 * i + 4) for i in range(1000)], "id string, file string, start int, end int")
    edges = observe.import_edges(observe.observed_edges(captures, spark.createDataFrame([("f", "h")], "path string, hash string"), symbols))
    assert graphs.most(edges, "Join", "numOutputRows") <= 200 * 2
    assert {(r["dst"], r["verified"]) for r in edges.collect()} == {("m4", 1), ("source_file:f", 1)} and edges.count() == 400


def test_edges_of_captures_come_about_where_the_captures_of_a_test_are(spark):
    sources = [{"file": "f", "sha256": "h", "ranges": [[1, 600]]}, {"file": None, "sha256": "h", "ranges": [[1, 2], None]}, {"file": "g", "sha256": "h", "ranges": [[0, 2], [3]]}]
    rows = [(f"t{i}", None, None, "s", at, sources if at else [{"file": "f", "sha256": "h", "ranges": [[9, 9999]]}], ["a", None] if i == 7 else None, []) for i in range(100) for at in (0, 1, 1)]
    captures = spark.createDataFrame([*rows, (None, None, None, "s", 1, sources, ["a"], []), ("x", None, None, None, 1, sources, ["a"], [])], observe.CAPTURE)
    symbols = spark.createDataFrame([(f"m{i}", "f", 10 * i, 10 * i + 4) for i in range(1000)], "id string, file string, start int, end int")
    manifest = F.broadcast(spark.createDataFrame([("f", "h")], "path string, hash string"))
    edges = observe.import_edges(observe.observed_edges(captures, manifest, symbols))
    assert graphs.most(edges, "Exchange", "shuffleRecordsWritten") <= len(rows) + 2
    seen = {(r["src"], r["dst"], r["verified"], r["unverified"]) for r in edges.collect()}
    assert seen == {(f"test:t{i}", d, 1, 0) for i in range(100) for d in ("source_file:f", *(f"m{j}" for j in range(61)))} | {("test:t7", "table:a", 0, 1), ("test:t7", None, 0, 1)}
    missing = observe.observed_edges(captures, manifest, symbols).where("freshness = 'missing'").collect()
    assert {(r["src"], r["dst"], r["observation"]) for r in missing} == {(f"test:t{i}", None, f"s#t{i}") for i in range(100)} and len(missing) == 100


def test_page_components(spark):
    df = spark.createDataFrame([('{"component":"A/B"}',), ('<div data-page="{&quot;component&quot;:&quot;C&quot;}">',), ("plain",)], "r string")
    assert [r[0] for r in df.select(observe.page_component(F.col("r"))).collect()] == ["A/B", "C", None]


def test_json_mirror(spark, g, tmp_path):
    path = str(tmp_path / "graph")
    json_graph.export(*g, path)
    json_graph.export(g[0].where("type <> 'route'"), g[1], path)
    (tmp_path / "graph" / "nodes" / "more.json").write_text('{"id": "broken"\n{"label": "no id"}\n{"id": "n", "type": "view"}\n')
    nodes, edges = json_graph.load(spark, path)
    assert {r["id"] for r in nodes.collect()} == {n[0] for n in graphs.NODES if n[1] != "route"} | {"n"}
    assert sorted(map(tuple, edges.collect())) == sorted(map(tuple, g[1].collect()))
