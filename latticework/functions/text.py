"""Terms, identifiers, tables in SQL texts, route templates, byte limits: text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that say nothing about a task (fixed values).
STOP_WORDS = ("a", "an", "and", "as", "at", "be", "by", "code", "feature", "for", "from", "in", "into", "is", "it", "make", "of", "on", "or", "refactor", "safely", "support", "task", "that", "the", "this", "to", "with")

MAX_TERMS, MAX_IDENTIFIERS = 64, 32


def stem(term: Column) -> Column:
    """ies → y, -ing (and one of a doubled last letter) and -ed gone, -s but not -ss; short words stay. Lengths are bytes."""
    n = F.octet_length(term)
    chars = F.length(term)
    ing = F.left(term, chars - 3)
    m = F.length(ing)
    undoubled = F.when((F.octet_length(ing) > 2) & (F.substring(ing, m, F.lit(1)) == F.substring(ing, m - 1, F.lit(1))), F.left(ing, m - 1)).otherwise(ing)
    return (
        F.when((n > 5) & term.endswith("ies"), F.concat(F.left(term, chars - 3), F.lit("y")))
        .when((n > 5) & term.endswith("ing"), undoubled)
        .when((n > 4) & term.endswith("ed"), F.left(term, chars - 2))
        .when((n > 4) & term.endswith("s") & ~term.endswith("ss"), F.left(term, chars - 1))
        .otherwise(term)
    )


def words(text: Column) -> Column:
    """Words of a text, ASCII letters lower-cased; words in camel case are split."""
    split = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    lower = F.translate(split, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def terms(text: Column, limit: int = MAX_TERMS) -> Column:
    """Distinct stems of a text's words that are no stop words, in order of appearance, limited."""
    kept = F.filter(F.transform(words(text), stem), lambda w: ~w.isin(*STOP_WORDS))
    return F.slice(F.array_distinct(kept), 1, limit)


def identifiers(text: Column, limit: int = MAX_IDENTIFIERS) -> Column:
    """Lower-cased identifiers: quoted, A::b, dotted, and capitalised words."""
    patterns = (r"[\"']([^\"']{1,512})[\"']", r"\b([A-Za-z_][A-Za-z0-9_\\]*::[A-Za-z_][A-Za-z0-9_]*)\b", r"\b([A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+)\b", r"\b([A-Z][A-Za-z0-9_\\]{2,})\b")
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns]
    return F.slice(F.array_distinct(F.transform(F.concat(*found), F.lower)), 1, limit)


def tables_in_sql(sql: Column, writes: bool | None = None) -> Column:
    """Sorted lower-cased table names of a statement: after FROM, JOIN (reads), INTO, UPDATE (writes), or all of them.

    Names of WITH queries and of system schemas are not tables; a schema before a name goes.
    """
    words_of = {None: "from|into|update|join", True: "into|update", False: "from|join"}[writes]
    name = r"((?:[`\"\[]?\w+[`\"\]]?\.)*[`\"\[]?\w+[`\"\]]?)"
    found = F.regexp_extract_all(sql, F.lit(rf"(?i)\b(?:{words_of})\s+{name}"), F.lit(1))
    clean = F.transform(found, lambda t: F.lower(F.regexp_replace(t, r"[`\"\[\]]", "")))
    own = F.filter(clean, lambda t: ~t.startswith("information_schema.") & ~t.startswith("pg_catalog.") & ~t.startswith("mysql."))
    ctes = F.transform(F.regexp_extract_all(sql, F.lit(r"(?i)(?:\bwith|,)\s+(?:recursive\s+)?(\w+)\s+as\s*\("), F.lit(1)), F.lower)
    return F.array_sort(F.array_distinct(F.array_except(F.transform(own, lambda t: F.regexp_extract(t, r"(\w+)$", 1)), ctes)))


def route_names(source: Column) -> Column:
    """Names given to the route helper, in order."""
    return F.regexp_extract_all(source, F.lit(r"\broute\(\s*['\"]([A-Za-z0-9_.\-]+)['\"]"), F.lit(1))


def literal_urls(source: Column) -> Column:
    """array<struct<method,url>>: literal targets of HTTP client calls."""
    call = r"\b(?:axios|http|\$http|client)\.(get|post|put|patch|delete)\(\s*['\"](/[^'\"]*)['\"]"
    return F.transform(F.arrays_zip(F.regexp_extract_all(source, F.lit(call), F.lit(1)).alias("m"), F.regexp_extract_all(source, F.lit(call), F.lit(2)).alias("u")), lambda x: F.struct(F.upper(x["m"]).alias("method"), x["u"].alias("url")))


def uri_pattern(template: Column) -> Column:
    """Anchored regular expression of a route template; {p?} may be left out with its slash."""
    quoted = F.regexp_replace(F.regexp_replace(template, r"^/+|/+$", ""), r"([.+*()\[\]^$|\\])", r"\\$1")
    optional = F.regexp_replace(quoted, r"/?\{\w+\?\}", "(?:/?[^/]+)?")
    return F.concat(F.lit("^/?"), F.regexp_replace(optional, r"\{\w+\}", "[^/]+"), F.lit("/?$"))


def with_segments(paths: DataFrame, path: str) -> DataFrame:
    """paths with the number of segments of each path, and its first segment."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return paths.withColumns({"segments": F.size(parts), "head": F.coalesce(F.get(parts, F.lit(0)), F.lit(""))})


def with_shapes(templates: DataFrame, template: str) -> DataFrame:
    """templates with each number of segments that a path of theirs may have, and the first segment, null unless it is literal.

    A segment may be left out where it is optional, or where its optional parameter has text around it that ends in a slash.
    """
    parts = F.filter(F.split(template, "/"), lambda x: x != "")
    optional = F.size(F.filter(parts, lambda x: x.rlike(r"\{\w+\?\}")))
    first = F.coalesce(F.get(parts, F.lit(0)), F.lit(""))
    return templates.withColumn("segments", F.explode(F.sequence(F.size(parts) - optional, F.size(parts)))).withColumn("head", F.when(~first.contains("{"), first))


def shape_join(paths: DataFrame, templates: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of equal keys, segments and first segment, if the template's is literal, to be compared by pattern: two equi-joins."""
    literal = paths.join(templates.where("head IS NOT NULL"), [*keys, "segments", "head"])
    return literal.unionByName(paths.join(templates.where("head IS NULL").drop("head"), [*keys, "segments"]).select(*literal.columns))


def path_of(url: Column) -> Column:
    """The path of a requested URL, without host, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/]+", ""), r"[?#].*$", "")


def _reference(kind: str, confidence: float):
    return lambda name: F.struct(F.lit(kind).alias("kind"), name.alias("name"), F.lit(confidence).alias("confidence"))


def view_names(source: Column) -> Column:
    """array<struct<kind,name,confidence>>: templates named by directives of a template; conditional forms are less sure."""
    forms = (("extends", r"@extends\(\s*['\"]([\w.\-/:]+)['\"]", 0.95), ("includes", r"@include(?:If)?\(\s*['\"]([\w.\-/:]+)['\"]", 0.95), ("includes", r"@include(?:When|Unless)\([^,]+,\s*['\"]([\w.\-/:]+)['\"]", 0.9), ("uses_component", r"@component\(\s*['\"]([\w.\-/:]+)['\"]", 0.95), ("uses_component", r"<x-([\w.\-:]+)", 0.9))
    return F.flatten(F.array(*[F.transform(F.regexp_extract_all(source, F.lit(p), F.lit(1)), _reference(kind, c)) for kind, p, c in forms]))


def masked_template(source: Column) -> Column:
    """A template without comments and verbatim blocks."""
    return F.regexp_replace(F.regexp_replace(source, r"(?s)\{\{--.*?--\}\}", ""), r"(?s)@verbatim.*?@endverbatim", "")


def truncate_bytes(text: Column, limit: int) -> Column:
    """At most so many UTF-8 bytes of a text, cut between code points."""
    raw = F.encode(text, "UTF-8")
    # the last byte kept must not be followed by a continuation byte (10xxxxxx)
    back = [F.substring(raw, limit + 1 - i, 1) for i in range(4)]
    is_tail = lambda b: F.conv(F.hex(b), 16, 10).cast("int").between(128, 191)
    cut = F.lit(limit - 3)
    for i in (2, 1, 0):
        cut = F.when(~is_tail(back[i]), limit - i).otherwise(cut)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.decode(F.substring(raw, F.lit(1), cut), "UTF-8"))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4)


def normal_path(path: Column, root: str = "") -> Column:
    """A project-relative path: separators and '.' parts normalised; null if it leaves the project."""
    p = F.regexp_replace(path, r"\\", "/")
    p = F.when(p.startswith(root + "/"), p.substr(F.lit(len(root) + 2), F.length(p))).otherwise(p) if root else p
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    return F.when(p.startswith("/") | F.array_contains(F.split(p, "/"), ".."), F.lit(None)).otherwise(F.array_join(parts, "/"))
