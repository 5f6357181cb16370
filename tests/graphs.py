"""Small literal graphs."""

NODES = [
    ("route:PUT:notes/{note}", "route", "PUT notes/{note}", "notes.update", "routes/web.src", 3, 3),
    ("NoteController::update", "method", "NoteController::update", None, "app/NoteController.src", 10, 30),
    ("NoteController::index", "method", "NoteController::index", None, "app/NoteController.src", 5, 8),
    ("NoteService::save", "method", "NoteService::save", None, "app/NoteService.src", 7, 20),
    ("NoteService::helper", "method", "NoteService::helper", None, "app/NoteService.src", 22, 30),
    ("App\\Models\\Note", "model", "Note", None, "app/Models/Note.src", 1, 40),
    ("App\\Models\\Tag", "model", "Tag", None, "app/Models/Tag.src", 1, 9),
    ("Other\\Tag", "model", "Tag", None, "other/Tag.src", 1, 9),
    ("UpdateNoteRequest", "form_request", "UpdateNoteRequest", None, "app/UpdateNoteRequest.src", 1, 12),
    ("table:notes", "table", "notes", "notes", None, None, None),
    ("table:tags", "table", "tags", "tags", None, None, None),
    ("column:notes.title", "column", "title", "title", None, None, None),
]
EDGES = [
    ("route:PUT:notes/{note}", "NoteController::update", "routes_to", 1.0),
    ("NoteController::update", "UpdateNoteRequest", "validates_with", 1.0),
    ("NoteController::update", "App\\Models\\Note", "uses_model", 0.9),
    ("NoteController::update", "NoteService::save", "calls", 1.0),
    ("NoteService::save", "NoteService::helper", "calls", 0.9),
    ("NoteService::helper", "NoteService::save", "calls", 0.8),
    ("NoteService::save", "table:notes", "writes", 0.85),
    ("NoteController::index", "table:notes", "reads", 0.9),
    ("App\\Models\\Note", "table:notes", "uses_table", 1.0),
    ("App\\Models\\Tag", "table:tags", "uses_table", 0.85),
    ("App\\Models\\Note", "App\\Models\\Tag", "belongs_to_many", 0.75),
    ("table:notes", "column:notes.title", "has_column", 1.0),
]


def frames(spark):
    from pyspark.sql import functions as F

    nodes = spark.createDataFrame(NODES, "id string, type string, label string, name string, file string, line int, end_line int")
    edges = spark.createDataFrame(EDGES, "src string, dst string, type string, confidence double").withColumn("confidence", F.col("confidence").cast("decimal(9,8)"))
    return nodes, edges


def most(df, kind: str, metric: str) -> int:
    """The largest value of a metric among the operators of a kind, in the plan that gives df's rows."""
    df.collect()

    def values(node):
        name = node.nodeName()
        yield from (node.metrics().apply(metric).value() for _ in range(kind in name and node.metrics().contains(metric)))
        inner = node.executedPlan() if name == "AdaptiveSparkPlan" else node.plan() if "QueryStage" in name else None
        for child in [inner] if inner else [node.children().apply(i) for i in range(node.children().size())]:
            yield from values(child)

    return max(values(df._jdf.queryExecution().executedPlan()))
