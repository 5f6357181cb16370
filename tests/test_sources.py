"""Parsers and facts on small inputs; the API end to end."""

import graphs
import pytest
from pyspark.sql import functions as F

from latticework.operators import store, verify
from latticework.plans import api, source_queries
from latticework.sources import accesses, facts, files, routing, schema_dump


def test_statements_respect_quotes_and_comments():
    assert schema_dump.statements("a 'x;y' -- b;\n; /* c; */ d \"e;\"\";\" ;; -- f;\r g") == ["a 'x;y'", "d \"e;\"\";\"", "g"]


def test_dumps_with_escapes_and_number_signs():
    one, two = schema_dump.parse(r"""CREATE TABLE t (a varchar(9) DEFAULT 'it\'s, (x', b int COMMENT 'o\'k, b', c int DEFAULT (x #> y), d int DEFAULT "q;"); CREATE TABLE u (e int NOT NULL); -- x; y""")
    assert [(c["name"], c["default"], c["comment"]) for c in one["columns"]] == [("a", r"it\'s, (x", None), ("b", None, "o'k, b"), ("c", "(x #> y)", None), ("d", "q;", None)]
    assert [c["name"] for c in two["columns"]] == ["e"]


def test_directive_arguments():
    read = lambda s: files.directive_arguments(s, s.index("("))
    assert read("x('a, (b', [1, 2], f(3)) tail") == ["'a, (b'", "[1, 2]", "f(3)"]
    assert read(r"x('it\'s, ok', \"(\")".replace('\\"', '"')) == [r"'it\'s, ok'", '"("']
    assert read("x('open, ") is None and read("x()") == [""]


def test_schema_dump():
    sql = """CREATE TABLE IF NOT EXISTS `notes` (
      `id` bigint unsigned NOT NULL AUTO_INCREMENT, `title` varchar(255) COLLATE utf8 DEFAULT NULL COMMENT 'it''s, ok', price decimal(8,2) NOT NULL DEFAULT '1.00', user_id integer references users(id),
      PRIMARY KEY (`id`), UNIQUE KEY `notes_title` (`title`, price), KEY (user_id), CONSTRAINT `fk_u` FOREIGN KEY (`user_id`) REFERENCES app.`users` (`id`) ON UPDATE NO ACTION ON DELETE SET NULL);
      CREATE TABLE tags (id serial PRIMARY KEY); CREATE INDEX tags_id ON public.tags USING btree (id);"""
    notes, tags = schema_dump.parse(sql)
    assert [(c["name"], c["type"], c["nullable"], c["default"], c["auto_increment"], c["comment"]) for c in notes["columns"]] == [("id", "bigint unsigned", False, None, True, None), ("title", "varchar(255)", True, None, False, "it's, ok"), ("price", "decimal(8,2)", False, "1.00", False, None), ("user_id", "integer", True, None, False, None)]
    assert [(i["name"], i["columns"], i["unique"], i["primary"]) for i in notes["indexes"]] == [("primary", ["id"], True, True), ("notes_title", ["title", "price"], True, False), ("notes_user_id_index", ["user_id"], False, False)]
    assert notes["foreign_keys"] == [{"name": "fk_u", "columns": ["user_id"], "foreign_table": "users", "foreign_columns": ["id"], "on_update": "no action", "on_delete": "set null"}]
    assert [i["name"] for i in tags["indexes"]] == ["primary", "tags_id"] and tags["columns"][0]["auto_increment"]


def test_collisions_of_dumps(spark):
    dumps = spark.createDataFrame([("a", "CREATE TABLE t (id int); CREATE TABLE u (id int);"), ("b", "create table t (id int, x int)"), ("c", None)], "source string, sql string")
    tables = schema_dump.parsed(dumps)
    assert [(r["name"], r["sources"]) for r in schema_dump.collisions(tables).collect()] == [("t", ["a", "b"])]
    assert {r["id"]: r["ambiguous"] for r in schema_dump.graph(tables)[0].where("type = 'table'").collect()} == {"table:t": True, "table:u": False}


def test_methods_are_found_up_the_hierarchy(spark):
    classes = spark.createDataFrame([("A", "B", ["T"]), ("B", "C", []), ("C", "A", [])], "class string, parent string, traits array<string>")
    above = facts.ancestry(classes)
    methods = spark.createDataFrame([("T", "run"), ("B", "run"), ("C", "scopeActive"), ("C", "stop")], "class string, method string")
    calls = spark.createDataFrame([("x", "A", "run", 0.9), ("x", "A", "active", 0.95), ("y", "B", "stop", 1.0), ("y", "B", "none", 1.0)], "caller string, class string, method string, confidence double")
    edges, missing = facts.resolve_methods(calls, methods, above)
    assert {(r["src"], r["dst"], r["confidence"]) for r in edges.collect()} == {("x", "T::run", 0.9), ("x", "C::scopeActive", 0.71), ("y", "C::stop", 1.0)}
    assert [(r["caller"], r["reason"], r["n"], r["first"]) for r in facts.diagnostics(missing).collect()] == [("y", "unresolved_method", 1, ["none"])]


def test_confidences_of_access_steps_round_as_sql(spark):
    roots = spark.createDataFrame([(1, "variable", "C", "t", 0.3)], "id int, kind string, class string, tbl string, confidence double")
    steps = spark.createDataFrame([(1, 1, "active", True)], "id int, position int, operation string, scope boolean")
    relationships = spark.createDataFrame([], "class string, method string, target_table string, pivot_table string, confidence double")
    assert [r["confidence"] for r in accesses.access_steps(roots, steps, relationships).collect()] == [0.28]  # SQL's round(0.3 * 0.95, 2)


def test_access_steps_of_items_in_any_order(spark, tmp_path):
    spark.createDataFrame([(1, 10), (2, 10)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    items = [(1, 1, 5, 7), (1, 1, 5, 9), (2, 1, None, 7), (2, 1, 6, 9)]
    for i in (1, -1):
        spark.createDataFrame(items[::i], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "lineitem.parquet"))
        assert {(r["id"], r["operation"]) for r in source_queries.access_steps(spark, str(tmp_path)).collect()} == {(1, "where"), (2, "active")}


_REGISTRATION = "registration int, prefixes array<string>, known boolean, uri string, method string, action string, kind string"
_ROUTE = "route string, method string, uri string, action string"


def test_pairs_of_registrations_and_routes_are_not_shuffled(spark):
    registrations = spark.createDataFrame([(i, ["api"], True, "x/", None, None, "view") for i in range(300)], _REGISTRATION)
    routes = spark.createDataFrame([(f"r{i}", "GET", "/api/x", "c") for i in range(300)], _ROUTE)
    pairs = routing.registered_routes(registrations, routes)
    assert graphs.most(pairs, "Exchange", "shuffleRecordsWritten") <= 1000
    assert pairs.count() == pairs.distinct().count() == 300 * 300


def test_templates_of_registrations_that_ask_the_same(spark):
    registrations = spark.createDataFrame([(i, ["api"], True, "x/", None, None, "view") for i in range(300)], _REGISTRATION)
    routes = spark.createDataFrame([(f"r{i}", "GET", "/api/x", "c") for i in range(300)], _ROUTE)
    found, lost = routing.route_templates(registrations, routes, registrations.selectExpr("registration", "'v' AS view", "0.9D AS confidence"))
    assert graphs.most(found, "Exchange", "shuffleRecordsWritten") <= 1000
    assert lost.count() == 0 and {tuple(r) for r in found.collect()} == {(f"r{i}", "view:v", "renders", 0.9, "exact") for i in range(300)}


def test_registrations_and_routes_with_several_rows(spark):
    asked = [(1, ["api"], True, "x/", None, None), (1, ["api"], True, "x/", "GET", None), (1, [], True, "/y", None, "c"), (2, ["no"], True, "x", "GET", None), (2, ["no"], True, "gone", None, None), (3, ["no"], False, "y", None, None), (3, ["no"], False, "x", None, None), (4, [], True, "/", None, None), (2, ["no"], True, "x", "GET", None)]
    routes = [("a", "GET", "/api/x", "c"), ("a", "POST", "/api/x", "c"), ("a", "GET", "/y", "c"), ("b", "POST", "/api/x", "d"), ("b", "POST", "/api/x", "d")]
    registrations = spark.createDataFrame([(*x, "closure") for x in asked], _REGISTRATION)
    r = spark.createDataFrame(routes, _ROUTE)
    matches = sorted(map(tuple, routing.registered_routes(registrations, r).collect()))
    assert matches == [(1, "a", "exact"), (1, "b", "exact"), (2, "a", "possible")]  # 3 ends in a and b, 4 in none
    found, lost = routing.route_templates(registrations, r, spark.createDataFrame([(i, "v", c) for i, c in ((1, 0.95), (2, 0.95), (3, 0.95), (4, 0.8))], "registration int, view string, confidence double"))
    assert {(x["src"], x["confidence"], x["certainty"]) for x in found.collect()} == {("a", 0.9, "exact"), ("b", 0.9, "exact")}
    assert sorted(x[0] for x in lost.collect()) == [3, 4]


def test_listeners_handlers_and_modes(spark):
    rows = spark.createDataFrame([("L", "handle", "E", 0.85, 0.9, True), ("M", "handle", "E", 1.0, 1.0, False)], "listener string, method string, event string, confidence double, binding double, proven boolean")
    listens, handled = facts.listeners(rows)
    assert {(r["src"], r["dst"], r["confidence"]) for r in listens.collect()} == {("L", "E", 0.77), ("M", "E", 1.0)}
    assert [(r["src"], r["dst"]) for r in handled.collect()] == [("E", "L::handle")]
    found = spark.createDataFrame([("J", None, None), ("K", "H", 0.9)], "job string, handler string, binding double")
    assert {(r["src"], r["dst"], r["confidence"]) for r in facts.handlers(found, spark.createDataFrame([("J",), ("I",)], "job string")).collect()} == {("J", "J::handle", 0.95), ("I", "I::handle", 0.95), ("K", "H::handle", 0.86)}
    modes = spark.createDataFrame([("dispatchAfterResponse", "job", True, True), ("dispatch", "event", True, True), ("dispatch", "job", False, True), ("dispatch", "job", True, True), ("dispatch", "job", True, False)], "o string, k string, known boolean, q boolean")
    assert [r[0] for r in modes.select(facts.dispatch_mode(F.col("o"), F.col("k"), F.col("known"), F.col("q"))).collect()] == ["after_response", "sync", "unknown", "queued", "sync"]


def test_templates(spark, tmp_path):
    for path, source in (("a/layout.blade.php", "x"), ("b/layout.blade.php", "y"), ("a/notes/show.blade.php", "@extends('layout') @include('notes.row') {{-- @include('gone') --}} @include('missing') <x-card/>"), ("a/notes/row.blade.php", "z"), ("a/card.blade.php", "c"), ("a/v.1/x.blade.php", "no")):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(source)
    found = files.find_files(spark, [str(tmp_path)], ("PHP",)).withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    assert found.count() == 6
    roots = spark.createDataFrame([(str(tmp_path / "a"), 0), (str(tmp_path / "b"), 1)], "root string, ordinal int")
    named = files.views(found, roots)
    assert {(r["name"], r["path"].split("/")[-2]) for r in named.collect()} >= {("layout", "a"), ("notes.show", "notes"), ("card", "a")}
    templates = named.join(found, "path").select("name", F.col("text").alias("source"))
    assert {(r["src"], r["dst"], r["type"], r["confidence"]) for r in files.template_edges(templates).collect()} == {("view:notes.show", "view:layout", "extends", 0.95), ("view:notes.show", "view:notes.row", "includes", 0.95), ("view:notes.show", "view:card", "uses_component", 0.9)}
    assert [(r["src"], r["target"]) for r in files.missing_templates(templates).collect()] == [("notes.show", "missing")]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    s = store.Store(spark, str(tmp_path_factory.mktemp("store")))
    nodes, edges = graphs.frames(spark)
    s.publish(nodes, edges)
    receipt = api.rebuild(s, nodes.where("id <> 'NoteService::helper'"), edges.where("NOT (src LIKE '%helper' OR dst LIKE '%helper' OR type = 'writes')"), str(tmp_path_factory.mktemp("lock") / "lock"))
    assert receipt["generation"] == 2 and receipt["changes"] == 4 and "writes" in receipt["details"]
    return api.Engine.of_store(s, 2), api.Engine.of_store(s, 1)


def test_named_queries(engine):
    new, old = engine
    assert old.query("overview")["node"]["method"] == 4
    assert {r["caller"] for r in old.query("writes-to", "Note")["results"]} == {"NoteService::save"}
    assert {r["node"] for r in old.query("calls-from", "NoteController::update")["results"]} == {"NoteService::save", "NoteService::helper"}
    assert {r["node"] for r in old.query("routes-touching", "column:notes.title")["results"]} == {"route:PUT:notes/{note}"}
    flow = old.query("flow-from", "route:PUT:notes/{note}")
    assert flow["dataAccess"] == [{"target": "table:notes", "confidence": 0.85, "depth": 1}] and flow["formRequests"]
    assert [r["id"] for r in old.query("search", "tags")["results"]] == ["table:tags"]
    assert old.query("context", "update the note title")["results"]
    assert new.query("verify", "NoteService::save")["status"] == "expected_graph_changes_observed"
    assert new.query("verify")["findings"][0]["code"] == "write_surface_removed"
    assert {r["kind"] for r in new.query("diff")["results"]} == {"removed"}
    with pytest.raises(LookupError):
        old.query("impact-of", "Tag")
    with pytest.raises(ValueError):
        old.query("nothing")
    for name in api.QUERIES:
        if name not in ("verify", "diff"):
            assert old.query(name, "NoteService::save")["query"] == name


def test_route_summaries(spark):
    rows = {r["group"]: r["targets"] for r in api.route_overview(*graphs.frames(spark)).collect()}
    assert rows["models"] == ["App\\Models\\Note"] and rows["dataAccess"] == ["table:notes"]


def test_statuses():
    assert verify.status(True, 0, False, 0, None, False) == "same_generation_selected"
    assert verify.status(False, 3, True, 1, 2, True) == "expected_and_collateral_graph_changes_observed_with_uncertainties"
    assert verify.status(False, 3, True, 0, None, False) == "graph_changes_observed"
