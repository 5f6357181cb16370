"""Vocabulary of the graph: record layouts, rule tables and ranks. Fixed values that results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

#: Path confidence is exact to 4 decimals at every step; doubles would round some products differently.
PATH_CONFIDENCE = "decimal(5,4)"
EDGE_CONFIDENCE = "decimal(9,8)"

NODE = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("type", T.StringType(), False), T.StructField("label", T.StringType()), T.StructField("name", T.StringType()), T.StructField("file", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("end_line", T.IntegerType())])
EDGE = T.StructType([T.StructField("src", T.StringType(), False), T.StructField("dst", T.StringType(), False), T.StructField("type", T.StringType(), False), T.StructField("confidence", T.DecimalType(9, 8))])

#: Edge types followed by execution traversals (fixed value).
EXECUTION = ("calls", "validates_with", "framework_invokes", "dispatches", "handled_by")

RELATIONSHIPS = ("belongs_to", "belongs_to_many", "has_one", "has_many", "has_one_through", "has_many_through", "morph_one", "morph_many", "morph_to", "morph_to_many", "morphed_by_many")

#: Incoming edge types that the impact closure follows, by the type of the node reached (fixed values).
IMPACT = {
    "column": ("has_column",),
    "table": ("reads", "writes", "uses_table"),
    "model": ("uses_model",),
    "form_request": ("validates_with",),
    "method": ("calls", "routes_to"),
    "view": ("renders", "includes", "extends", "uses_component"),
    "class": ("uses_component",),
}

#: Outgoing edge types that the planner follows, by node type (fixed values).
DOWNSTREAM = {
    "route": ("routes_to", "passes_through", "renders"),
    "method": ("calls", "validates_with", "dispatches", "renders"),
    "form_request": ("framework_invokes",),
    "event": ("handled_by",),
    "job": ("handled_by",),
    "view": ("includes", "extends", "uses_component"),
}

#: Incoming edge types that the planner follows, by node type; tables and columns never expand (fixed values).
UPSTREAM = {
    "method": ("calls", "routes_to", "passes_through", "framework_invokes", "handled_by", "authorizes_via"),
    "form_request": ("validates_with",),
    "model": ("uses_model", "observes", *RELATIONSHIPS),
    "route": ("tests_route", "consumes_route"),
    "event": ("dispatches",),
    "job": ("dispatches",),
    "view": ("renders",),
    "class": ("uses_component",),
    "table": (),
    "column": (),
}
UPSTREAM_OTHER = ("reads_cache", "writes_cache", "reads_filesystem", "writes_filesystem", "calls_external")

#: Edge types over which the verification neighbourhood goes on (fixed values).
BRIDGES = ("routes_to", "passes_through", "calls", "validates_with", "framework_invokes", "dispatches", "handled_by", "listens_to", "observes", "resolves_to")

#: Diff categories in order of precedence: node types, edge types (fixed values); else the kind of fact.
CATEGORIES = (
    ("tests", ("test", "test_file"), ("tests_route", "runtime_covers", "runtime_touches_table", "runtime_renders", "runtime_renders_component")),
    ("authorization", ("policy",), ("authorizes_via",)),
    ("writes", (), ("writes", "writes_cache", "writes_filesystem")),
    ("queues", ("event", "job"), ("dispatches", "handled_by", "listens_to", "observes")),
    ("routes", ("route",), ("routes_to", "passes_through", "consumes_route")),
    ("views", ("view",), ("renders", "includes", "extends", "uses_component")),
)

#: Order in which a reading plan shows nodes: by the role of an incoming edge, else by node type (fixed values).
READ_ROLE = {"passes_through": 10, "authorizes_via": 30, "routes_to": 40, "handled_by": 70, "renders": 75}
READ_TYPE = {"form_request": 20, "policy": 30, "route": 40, "class": 50, "method": 50, "trait": 50, "model": 60, "event": 70, "job": 70, "view": 75, "frontend": 80, "test": 90}
READ_OTHER = 55

SEED_SOURCE = {"explicit": 0, "changed_file": 1, "identifier": 2, "lexical": 3}
SEED_TYPE = {"route": 0, "method": 1, "form_request": 2, "model": 3, "event": 3, "job": 3, "view": 3, "test": 4, "table": 5, "column": 5}
DIRECTION = {"seed": 0, "downstream": 1, "upstream": 2}
FRESHNESS = ("verified", "unverified", "stale", "missing")
