"""Whether an access touches a column, and how sure a confidence is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def names_column(field: Column, column: Column, table: Column) -> Column:
    """Whether a field text names the column: itself, before '.' or '->', or after the table's name."""
    own = F.concat(table, F.lit("."), column)
    return (field == column) | (F.split(field, r"->|\.")[0] == column) | (field == own) | field.startswith(F.concat(own, F.lit("->"))) | field.startswith(F.concat(own, F.lit(".")))


def classify(operations: Column, column: Column, table: Column, cap: int | None = None) -> Column:
    """proven, possible or excluded, from array<struct<operation,fields,coverage>>; beyond a cap nothing is excluded."""
    seen = F.slice(operations, 1, cap) if cap else operations
    dynamic = lambda o: F.exists(o["fields"], lambda f: f.contains("{dynamic}"))
    proven = F.exists(seen, lambda o: (o["coverage"] == "whole_row") | F.exists(o["fields"], lambda f: names_column(f, column, table)))
    unsure = F.exists(seen, lambda o: o["coverage"].isNull() | (o["coverage"] == "unknown") | dynamic(o))
    cut = (F.size(operations) > cap) if cap else F.lit(False)
    return F.when(F.coalesce(F.size(operations) == 0, F.lit(True)), "possible").when(proven, "proven").when(unsure | cut, "possible").otherwise("excluded")


def uncertainty(confidence: Column) -> Column:
    """Null from 0.9, inferred from 0.6, else low."""
    return F.when(confidence >= 0.9, F.lit(None).cast("string")).when(confidence >= 0.6, "inferred").otherwise("low")
