"""Personal data by weak supervision.

Strict patterns give the base spans, which always stay. Looser patterns give further candidates. Labelers vote on every
span for, against or not at all: the strict pattern, gazetteers (mail providers and top-level domains, calling codes, card
prefixes, reserved address ranges), context words before it, words that speak against it, and its shape. Expectation
maximisation over the counts of vote patterns estimates each labeler's reliability, by kind, and from these the share of
true spans in each pattern; a logistic classifier over votes and shape is trained on those shares and decides which
candidates become spans. What is counted is one row for each distinct pattern of votes and features, whose number is
bounded by their alphabets, over all documents.

Offsets are code points, ends exclusive. Defined results: a null or empty text has no spans; repeated ids give repeated
rows; an empty table trains on the priors alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import record_batch, steps, written

KINDS = ("email", "ip", "card", "phone")

#: The strict patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: An address that does not begin at the first digit of a run does not begin at a later one either.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Looser ones, for candidates.
_LOOSE = (
    (0, re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}[ ]?(?:\[at\]|\(at\)|\{at\}|[ ]at[ ])[ ]?[A-Za-z0-9-]{2,63}(?:[ ]?(?:\[dot\]|\(dot\)|\{dot\}|[ ]dot[ ]|\.)[ ]?[A-Za-z]{2,24}){1,3}(?![A-Za-z0-9])"), re.compile(r"\[at\]|\(at\)|\{at\}| at [\x20]?[A-Za-z0-9-]{2,63}(?:\.|[ ]\.| {1,2}dot |[ ]?(?:\[dot\]|\(dot\)|\{dot\}))")),
    (1, re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"), re.compile(r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:")),
    (2, re.compile(r"(?<![0-9])[0-9]{4}(?:[.\x20-][0-9]{4}){3}(?![0-9])"), re.compile(r"[0-9]{4}[.\x20-][0-9]{4}")),
    (3, re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-]|0[0-9]{1,4}[ /-])[0-9]{3,4}[ .-][0-9]{3,5}(?![0-9])"), re.compile(r"[0-9][ .-][0-9]{3}")),
)
#: Every strict pattern needs a digit or '@', every looser one these or its hint.
_ANY = re.compile("[0-9@]|" + "|".join(f"(?:{hint.pattern})" for _, _, hint in _LOOSE[:2]))

TOP_LEVEL = frozenset("com org net edu gov de fr es uk io info eu ch at it nl".split())
CALLING = ("1", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "81", "86", "91")
CARD_PREFIX = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65", "22", "36", "30")
CUES = (
    re.compile(r"mail|contact|write|correo|courriel|schreib", re.I),
    re.compile(r"\bip\b|address|host|server|from|client|adresse", re.I),
    re.compile(r"card|visa|master|amex|credit|karte|carte|tarjeta|payment", re.I),
    re.compile(r"tel|phone|call|fax|mobil|whatsapp|rufen|appel|llam", re.I),
)
AGAINST = re.compile(r"version|isbn|issn|doi|order|invoice|rev\b|build|release|section|chapter|§|#\s*$|\bv\s*$", re.I)
CONTEXT = 40
N_LABELERS = 5  # strict pattern, gazetteer, context, words against, shape


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += (x * 2 - 9 if x > 4 else x * 2) if i % 2 else x
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the mail pattern: back from every '@' over its own run of characters, which no other one shares."""
    cursor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > cursor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        cursor = m.end() if m else at + 1
        if m:
            yield start, m.end()
        at = text.find("@", cursor)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strict patterns, in that order."""
    out = [(a, 0, b) for a, b in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(int(p[-9:]) <= 255 and not p[:-9].strip("0") for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = re.sub("[ -]", "", m.group())
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


def _votes(text: str, kind: int, start: int, end: int, strict: bool) -> tuple[int, ...]:
    value = text[start:end]
    digits = re.sub("[^0-9]", "", value)
    before = text[max(0, start - CONTEXT) : start]
    if kind == 0:
        known = 1 if re.split(r"[^A-Za-z]+", value)[-1].lower() in TOP_LEVEL else -1
        shape = 1 if re.search("[A-Za-z]{2}", value) else -1
    elif kind == 1:
        known = -1 if value.startswith(("0.", "255.", "127.")) else 1
        shape = 1 if len(set(digits)) > 2 else -1
    elif kind == 2:
        known = 1 if digits.startswith(CARD_PREFIX) else -1
        shape = 1 if luhn(digits) and len(set(digits)) > 3 else -1
    else:
        known = (1 if digits.startswith(CALLING) else -1) if strict else 0
        shape = 1 if len(set(digits)) > 3 and 9 <= len(digits) <= 15 else -1
    return (1 if strict else -1, known, 1 if CUES[kind].search(before) else 0, -1 if AGAINST.search(before[-16:]) else 0, shape)


def _apart(found: Iterator[re.Match], taken: list[tuple[int, int]]) -> list[re.Match]:
    """Matches, in order, that overlap none of the spans, which are in order and apart."""
    out, i = [], 0
    for m in found:
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        if i == len(taken) or m.end() <= taken[i][0]:
            out.append(m)
    return out


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def candidates(text: str) -> list[tuple[int, int, int, bool, int]]:
    """(start, kind, end, base, vote pattern) of every span to decide on. The pattern is a number in base 3."""
    if not _ANY.search(text):
        return []
    spans = [(a, k, b, True) for a, k, b in base_spans(text)]
    for kind, pattern, hint in _LOOSE:
        if hint.search(text):
            spans += [(m.start(), kind, m.end(), False) for m in _apart(pattern.finditer(text), _joined([(a, b) for a, _, b, _ in spans]))]
    out = []
    for a, k, b, strict in sorted(spans):
        code = 0
        for v in _votes(text, k, a, b, strict):
            code = code * 3 + v + 1
        out.append((a, k, b, strict, code))
    return out


def decoded(codes: np.ndarray) -> np.ndarray:
    """Votes (-1, 0, 1) of vote patterns, a row each."""
    return np.stack([codes // 3 ** (N_LABELERS - 1 - j) % 3 - 1 for j in range(N_LABELERS)], 1) if len(codes) else np.zeros((0, N_LABELERS), int)


def estimate(codes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation maximisation over counted vote patterns: P(true) of each pattern, and the labelers' P(vote | truth).

    Two classes; a labeler votes independently of the others given the truth. Pseudo-counts say that a vote is right four
    times of five, which also names the classes.
    """
    votes = decoded(codes) + 1
    prior = np.array([[[4.0, 3.0, 1.0], [1.0, 3.0, 4.0]]] * N_LABELERS) * 5  # [labeler][truth][vote]
    theta, share = prior / prior.sum(2, keepdims=True), 0.5
    p = np.zeros(len(codes))
    for _ in range(rounds):
        log = np.log(theta)
        ll = np.stack([sum(log[j, c, votes[:, j]] for j in range(N_LABELERS)) for c in (0, 1)], 1) if len(codes) else np.zeros((0, 2))
        ll += np.log([1 - share, share])
        p = 1 / (1 + np.exp(np.clip(ll[:, 0] - ll[:, 1], -50, 50)))
        new = prior.copy()
        for j in range(N_LABELERS):
            np.add.at(new[j, 1], votes[:, j], counts * p)
            np.add.at(new[j, 0], votes[:, j], counts * (1 - p))
        theta, share = new / new.sum(2, keepdims=True), (5 + (counts * p).sum()) / (10 + counts.sum())
    return p, theta


def features(kinds: np.ndarray, codes: np.ndarray) -> np.ndarray:
    votes = decoded(codes)
    x = [np.ones(len(codes)), *(votes == 1).T, *(votes == -1).T, *(kinds == k for k in range(len(KINDS)))]
    return np.stack(x, 1).astype(float)


def train(rows: list[tuple[int, int, int]]) -> dict[tuple[int, int], float]:
    """P(personal data) of each (kind, vote pattern), from (kind, pattern, count) over the corpus."""
    if not rows:
        return {}
    kinds, codes, counts = (np.array(x) for x in zip(*sorted(rows), strict=True))
    target = np.zeros(len(codes))
    for k in set(kinds.tolist()):
        at = kinds == k
        target[at] = estimate(codes[at], counts[at].astype(float))[0]
    x, w = features(kinds, codes), np.zeros(1 + 2 * N_LABELERS + len(KINDS))
    weight = counts / counts.sum() * min(counts.sum(), 1e5)
    for _ in range(25):  # Newton's method with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w += np.clip(np.linalg.solve(h, x.T @ (weight * (target - p)) - w), -2, 2)
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return {(int(k), int(c)): float(v) for k, c, v in zip(kinds, codes, p, strict=True)}


_TYPES = {"doc_id": pa.int64(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("base", pa.bool_()), ("code", pa.int32())]))}


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id and spans array<struct<start,kind,end,base,code>> of every text: the strict ones, and candidates whose vote pattern (code) is over the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in steps(batches):
            spans = [[dict(zip(("start", "kind", "end", "base", "code"), s, strict=True)) for s in candidates(t.decode())] for t in texts]
            yield record_batch({"doc_id": ids, "spans": spans}, _TYPES)

    found = written(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, spans array<struct<start:bigint,kind:int,end:bigint,base:boolean,code:int>>"), "pii")
    # at most 4 kinds * 3^5 vote patterns come to the driver
    seen = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.code").count().collect()
    p = train([(r["kind"], r["code"], r["count"]) for r in seen])
    accepted = sorted(f"{k}:{c}" for (k, c), v in p.items() if v > threshold)
    key = lambda s: F.concat_ws(":", s["kind"].cast("string"), s["code"].cast("string"))
    keep = lambda s: s["base"] | F.array_contains(F.array(*map(F.lit, accepted)).cast("array<string>"), key(s))
    return found.select("doc_id", F.filter("spans", keep).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans (kind:start:end) from personal_spans()."""
    names = F.array(*map(F.lit, KINDS))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda k: F.filter("spans", lambda s: s["base"] & (s["kind"] == k))
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(shown(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def brute_force_base(text: str | None) -> tuple[list[tuple[int, int, int]], str]:
    """Base spans by the plain patterns, and their digest."""
    t, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(d := re.sub("[ -]", "", m.group())) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    out.sort()
    return out, hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in out).encode()).hexdigest()
