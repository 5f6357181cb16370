"""Secret scans, with DataFrame functions only.

Credential patterns give the base spans. Beside them, runs of key-like characters are candidates: a window slides over each,
its counts of the run's character class (hexadecimal, else base 64) change by the character that enters and the one that
leaves, and the Shannon entropy of the window follows from the running sum of c * log2(c). A candidate whose highest window
entropy reaches its class's threshold is a span of kind ``entropy``, unless an allow-list pattern covers it, it overlaps a
base span, or it lacks digits or letters.

Offsets are code points, ends exclusive. Defined results: a null or empty text has no spans; repeated ids give repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The credential patterns.
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex", "entropy")

CLASSES = {"hex": "0123456789abcdefABCDEF", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"}
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
WINDOW = 20
#: Spans of a block.
BLOCK = 64
THRESHOLDS = {"hex": 3.0, "base64": 3.9}
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|placeholder|changeme|dummy|redacted|lorem",
    r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//|^www",
    r"^/?(?:(?:[A-Z]?[a-z]{2,}+[0-9]{0,4}+|[A-Z]{2,}+)(?:[_=-](?:[a-z]{2,}+|[0-9]{1,4}+))*+/){2,}+[A-Za-z0-9_=-]*$",
    r"^(.)\1+$",
    r"^[0-9+/_=-]+$",
    r"^[A-Za-z/_=-]+$",
)


_SPANS = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"


def _blocks(n: Column) -> Column:
    """Numbers of the blocks of so many elements."""
    return F.when(n > 0, F.sequence(F.lit(0), ((n - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))


def _part(elements: Column, block: Column) -> Column:
    return F.slice(elements, block * BLOCK + 1, F.lit(BLOCK))


def _spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """array<struct<start,kind,end,value>> of the pattern's matches, from the text around and in them.

    Places are running sums, within blocks of matches and over the blocks, so that many matches do not cost their square.
    """
    rest = F.split(text, pattern, -1)
    pairs = F.transform(F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.slice(rest, 1, F.size(rest) - 1).alias("g")), lambda x: F.struct(x["m"].alias("m"), F.length(x["g"]).cast("long").alias("gap"), F.length(x["m"]).cast("long").alias("n")))

    def placed(of: Column) -> Column:
        total = lambda block: F.aggregate(_part(of, block), F.lit(0).cast("long"), lambda a, x: a + x["gap"] + x["n"])
        nothing = F.array().cast("array<struct<block:int,at:bigint>>")
        begins = F.aggregate(
            _blocks(F.size(of)), F.struct(F.lit(0).cast("long").alias("at"), nothing.alias("out")),
            lambda a, k: F.struct((a["at"] + total(k)).alias("at"), F.concat(a["out"], F.array(F.struct(k.alias("block"), a["at"].alias("at")))).alias("out")), lambda a: a["out"],
        )
        return F.flatten(F.transform(begins, lambda b: F.aggregate(
            _part(of, b["block"]), F.struct(b["at"].alias("at"), F.array().cast(_SPANS).alias("out")),
            lambda a, x: F.struct(
                (a["at"] + x["gap"] + x["n"]).alias("at"),
                F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (a["at"] + x["gap"] + x["n"]).alias("end"), x["m"].alias("value")))).alias("out"),
            ), lambda a: a["out"],
        )))

    # bound once, so that the matches are not sought anew for every use
    spans = F.get(F.transform(F.array(pairs), placed), F.lit(0))
    return F.when(text.rlike(pattern), F.filter(spans, keep) if keep else spans).otherwise(F.array().cast(_SPANS))


def max_window_entropy(value: Column, alphabet: str, window: int) -> Column:
    """Highest Shannon entropy (bits) of a window of so many characters (or of the whole value, if shorter)."""
    weight = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    at = lambda i: F.instr(F.lit(alphabet), F.substring(value, i, F.lit(1)))  # noqa: E731  0: outside the class
    size = F.least(F.length(value), F.lit(window))
    # the counts of several characters are bits of one number, so that a step changes two numbers and not a list
    bits = window.bit_length()
    each = 63 // bits
    words = [f"c{k}" for k in range(-(-(len(alphabet) + 1) // each))]
    one = F.lit(1).cast("long")
    place = lambda c: (F.pmod(c, F.lit(each)) * bits).cast("int")
    owner = lambda c: F.floor(c / each).cast("int")

    def count(a: Column, c: Column) -> Column:
        held = F.get(F.array(*(a[w] for w in words)), owner(c))
        return F.call_function("shiftright", held, place(c)).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")

    def slide(a: Column, i: Column) -> Column:
        enters, leaves = at(i), F.when(i > window, at(i - window)).otherwise(F.lit(-1))

        def moved(x: Column) -> Column:
            new, old = x["enters"], x["leaves"]
            came, left = count(a, new), F.when(old >= 0, count(a, old))
            total = F.when(new == old, a["total"]).otherwise(a["total"] + weight(came + 1) - weight(came) + F.when(old >= 0, weight(left - 1) - weight(left)).otherwise(F.lit(0.0)))
            change = lambda k, c: F.when(owner(c) == k, F.call_function("shiftleft", one, place(c))).otherwise(F.lit(0).cast("long"))
            counts = [(a[w] + change(k, new) - F.when(old >= 0, change(k, old)).otherwise(F.lit(0).cast("long"))).alias(w) for k, w in enumerate(words)]
            entropy = F.log2(size.cast("double")) - total / size
            return F.struct(*counts, total.alias("total"), F.when(i >= size, F.greatest(a["best"], entropy)).otherwise(a["best"]).alias("best"))

        return F.get(F.transform(F.array(F.struct(enters.alias("enters"), leaves.alias("leaves"))), moved), F.lit(0))

    start = F.struct(*(F.lit(0).cast("long").alias(w) for w in words), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
    return F.when(F.length(value) > 0, F.aggregate(F.sequence(F.lit(1), F.length(value)), start, slide, lambda a: a["best"])).otherwise(F.lit(0.0))


def _suspicious(span: Column) -> Column:
    value = span["value"]
    allowed = F.lit(False)
    for p in ALLOWED:
        allowed = allowed | value.rlike(p)
    is_hex = value.rlike("^[0-9a-fA-F]+$")
    high = F.when(is_hex, max_window_entropy(value, CLASSES["hex"], WINDOW) >= THRESHOLDS["hex"]).otherwise(max_window_entropy(value, CLASSES["base64"], WINDOW) >= THRESHOLDS["base64"])
    return ~allowed & high


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, or the columns to keep, with scanned (the text, a null as empty) and spans array<struct<start,kind,end,value>>.

    Spans are in order of start, then kind (0..3, see KINDS).
    """
    kept = [docs[c] for c in keep] if keep else [docs[id_col].alias("doc_id")]
    names = keep or ["doc_id"]
    base = docs.select(*kept, F.coalesce(docs[text_col], F.lit("")).alias("scanned"))
    text = F.col("scanned")
    long_value = lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= 6
    found = base.withColumns({
        "base_spans": F.concat(_spans(text, ASSIGN, 0, long_value), _spans(text, ACCESS, 1, lambda s: F.length(s["value"]) >= 20), _spans(text, HEX, 2)),
        "candidates": _spans(text, CANDIDATE, 3),
    })
    # base spans in order, by blocks with their first start and last end: a candidate looks into the blocks that it meets.
    # Both are bound as arguments, since a column that is used once is put in where it stands, and computed for every candidate
    meets = lambda s, c: (s["start"] < c["end"]) & (c["start"] < s["end"])
    bounds = lambda part: F.struct(F.array_min(F.transform(part, lambda s: s["start"])).alias("low"), F.array_max(F.transform(part, lambda s: s["end"])).alias("high"), part.alias("spans"))
    grouped = lambda ordered: F.transform(_blocks(F.size(ordered)), lambda k: bounds(_part(ordered, k)))
    apart = lambda groups, c: ~F.exists(groups, lambda g: (g["low"] < c["end"]) & (c["start"] < g["high"]) & F.exists(g["spans"], lambda s: meets(s, c)))
    chosen = lambda groups: F.filter("candidates", lambda c: apart(groups, c) & _suspicious(c))
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    extra = once(F.array_sort("base_spans"), lambda ordered: once(grouped(ordered), chosen))
    spans = F.array_sort(F.concat("base_spans", F.when(F.size("candidates") > 0, extra).otherwise(F.col("candidates"))))
    return found.select(*names, "scanned", spans.alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256 and spans (kind:start:end, comma-joined) from secret_spans()."""
    names = F.array(*map(F.lit, KINDS))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(shown(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def redacted(spans: Column, text: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones as one, replaced by a mark. Spans are in order of their start.

    A block of spans at a time is cut from the text, and its spans from that cut.
    """

    def block(a: Column, k: Column) -> Column:
        part = _part(spans, k)
        return F.get(F.transform(F.array(F.greatest(a["at"], F.array_max(F.transform(part, lambda s: s["end"])))), lambda to: F.get(F.transform(
            F.array(F.substring(text, (a["at"] + 1).cast("int"), (to - a["at"]).cast("int"))),
            lambda cut: F.struct(to.alias("at"), F.concat(a["out"], F.aggregate(
                part, F.struct(a["at"].alias("at"), F.lit("").alias("out")),
                lambda b, s: F.struct(
                    F.greatest(b["at"], s["end"]).alias("at"),
                    F.when(s["start"] < b["at"], b["out"]).otherwise(F.concat(b["out"], F.substring(cut, (b["at"] - a["at"] + 1).cast("int"), (s["start"] - b["at"]).cast("int")), F.lit(mark))).alias("out"),
                ), lambda b: b["out"],
            )).alias("out")),
        ), F.lit(0))), F.lit(0))

    done = F.aggregate(
        _blocks(F.size(spans)), F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), block,
        lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)
