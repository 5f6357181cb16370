"""Benchmark decontamination by Wu-Manber search for all benchmark windows at once.

The alphabet is words (by hash), a pattern is a window of consecutive item words, and the patterns of one length are one
searcher. Its SHIFT table says, for a hashed block of two words (one for patterns of one word), how far a position that
ends in it may move without passing an occurrence; where that is 0, the hash of the last words tells whether any pattern ends
so, the hash of all words selects the patterns to test, and the words themselves are compared. Many stretches of text, which
overlap by a pattern less a word, are searched in step by array operations, so that a very long document does not hold up the
others.

Patterns are sent to the workers in blocks of bounded size, and compiled once a worker; a larger benchmark takes several
passes, each of which adds its hits to those of the one before.

Defined results: null, empty or wordless texts have no words, no hit and no items; items that are null or without words
never occur; repeated items each count; repeated document ids give repeated rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import discard, filtered, record_batch, steps, written
from latticework.llm.words import ALNUM, Words, mix, words_of

WINDOW = 10
#: Bytes of benchmark text searched for in one pass.
BLOCK_BYTES = 8 << 20
STRETCH = 256
#: Bytes of the smallest block whose searchers a worker keeps for its next task.
KEPT = 1 << 20
#: Bytes compared directly at a time.
COMPARED = 1 << 20


class Searcher:
    """Wu-Manber tables for the distinct patterns of one length, all in arrays over the words of the items."""

    def __init__(self, words: Words, hashes: np.ndarray, length: int, starts: np.ndarray, owners: np.ndarray) -> None:
        """starts: the first words of all patterns of the length, whose items are owners (both with repeats)."""
        self.words, self.length, self.block = words, length, min(2, length)
        whole = self.whole(hashes, starts)
        order = np.lexsort((owners, whole))
        starts, owners, whole = starts[order], owners[order], whole[order]
        new = np.append(True, whole[1:] != whole[:-1])
        # patterns of equal hash are one if their words are equal; else (all but never) each stays by itself
        same = ~new
        same[~new] = equal_words(words, starts[1:][~new[1:]], words, starts[:-1][~new[1:]], length) if (~new).any() else same[~new]
        first = np.flatnonzero(~same)
        #: Distinct patterns, by rising hash of all of their words, and the items of each.
        self.hash, self.start = whole[first], starts[first]
        self.items, self.item_from = owners, np.append(first, len(owners))
        bits = self.bits = int(np.clip(np.ceil(np.log2(max(1, 16 * len(first)))), 12, 24))
        self.shift = np.full(1 << bits, length - self.block + 1, np.uint8 if length < 250 else np.int32)
        for j in range(self.block, length + 1):
            np.minimum.at(self.shift, self.slots(hashes, self.start + j - 1), length - j)
        self.suffixes = np.unique(self.suffix(hashes, self.start + length - 1))

    def whole(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Hash of all words of runs that begin at some places."""
        out = hashes[starts] * np.uint64(0x9E3779B97F4A7C15)
        for j in range(1, self.length):
            out = mix(out ^ hashes[starts + j])
        return out

    def slots(self, hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Slots of the shift table for the blocks of words that end at some places."""
        h = hashes[last] if self.block == 1 else hashes[last - 1] * np.uint64(0x9E3779B97F4A7C15) ^ hashes[last]
        return (mix(h) >> np.uint64(64 - self.bits)).astype(np.int64)

    def suffix(self, hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hash of the last four words."""
        out = hashes[last]
        for j in range(1, min(4, self.length)):
            out = mix(out ^ hashes[last - j] * np.uint64(0xD1342543DE82EF95))
        return out

    def candidates(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Places of the first words of possible occurrences; texts begin at first[:-1]."""
        m = self.length
        counts = np.diff(first)
        step = max(STRETCH, 4 * m)
        pieces = np.maximum(0, -(-(counts - m + 1) // step))
        owner = np.repeat(np.arange(len(counts)), pieces)
        starts = first[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * step
        stops = np.minimum(starts + step + m - 1, first[owner + 1])
        at, found = starts + m - 1, []
        while len(at):
            move = self.shift[self.slots(hashes, at)].astype(np.int64)
            hit = move == 0
            if hit.any():
                found.append(at[hit])
                move[hit] = 1
            at = at + move
            on = at < stops
            at, stops = at[on], stops[on]
        if not found:
            return np.zeros(0, np.int64)
        places = np.concatenate(found)
        keys = self.suffix(hashes, places)
        near = np.minimum(np.searchsorted(self.suffixes, keys), len(self.suffixes) - 1)
        return places[self.suffixes[near] == keys] - (m - 1)

    def occurrences(self, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of first words, numbers of patterns) of all occurrences, after direct comparison."""
        at = self.candidates(hashes, words.first)
        key = self.whole(hashes, at)
        low, high = np.searchsorted(self.hash, key), np.searchsorted(self.hash, key, side="right")
        n = high - low
        at, pattern = np.repeat(at, n), np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        equal = equal_words(words, at, self.words, self.start[pattern], self.length)
        return at[equal], pattern[equal]

    def items_of(self, patterns: np.ndarray) -> np.ndarray:
        """Distinct items of some patterns."""
        patterns = np.unique(patterns)
        return np.unique(np.concatenate([self.items[self.item_from[p] : self.item_from[p + 1]] for p in patterns.tolist()]))


def equal_words(a: Words, at_a: np.ndarray, b: Words, at_b: np.ndarray, length: int) -> np.ndarray:
    """Whether so many words from one place on equal those from another, byte by byte."""
    equal = np.ones(len(at_a), bool)
    for j in range(length):
        on = np.flatnonzero(equal)
        sa, sb = a.start[at_a[on] + j], b.start[at_b[on] + j]
        n = a.end[at_a[on] + j] - sa
        same = n == b.end[at_b[on] + j] - sb
        equal[on[~same]] = False
        on, sa, sb, n = on[same], sa[same], sb[same], n[same]
        ends = np.cumsum(n)
        # a bounded number of bytes at a time, or one word
        k = 0
        while k < len(on):
            e = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + COMPARED, side="right")))
            size = n[k:e]
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            differ = a.data[inner + np.repeat(sa[k:e], size)] != b.data[inner + np.repeat(sb[k:e], size)]
            equal[on[k:e]] &= np.bincount(np.repeat(np.arange(e - k), size)[differ], minlength=e - k) == 0
            k = e
    return equal


def compile_items(items: list[tuple[int, bytes]], window: int = WINDOW) -> list[Searcher]:
    """Searchers, by length, for the windows of items; an item with fewer words is one window."""
    words = words_of([t for _, t in items], ALNUM)
    hashes, counts = words.hashes(), words.counts
    keys = np.array([k for k, _ in items], np.int64)
    out = []
    for size in np.unique(np.minimum(counts, window)).tolist():
        if size:
            which = np.flatnonzero(np.minimum(counts, window) == size)
            n = counts[which] - size + 1
            starts = np.repeat(words.first[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append(Searcher(words, hashes, size, starts, np.repeat(keys[which], n)))
    return out


#: Searchers of the block that this worker compiled last.
_compiled: dict[str, list[Searcher]] = {}


def compiled(block: tuple[str, list[tuple[int, bytes]]], window: int) -> list[Searcher]:
    """Searchers of a named block of items, made once a worker, which takes its tasks in turn; those of a small block are not kept."""
    if sum(len(t) for _, t in block[1]) < KEPT:
        return compile_items(block[1], window)
    key = f"{block[0]} {window}"
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = compile_items(block[1], window)
    return _compiled[key]


def search(searchers: list[Searcher], texts: list[bytes]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[int]]]:
    """For each text: number of words, hit ranges of words, and items that occur."""
    words = words_of(texts, ALNUM)
    hashes = words.hashes()
    ranges: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[int]] = [set() for _ in texts]
    for s in searchers:
        at, pattern = s.occurrences(words, hashes)
        doc = words.doc[at]
        order = np.lexsort((at, doc))
        at, doc, pattern = at[order], doc[order], pattern[order]
        cuts = np.flatnonzero(np.diff(doc, prepend=-1, append=-1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            d = int(doc[a])
            place = np.unique(at[a:b]) - words.first[d]
            new = np.append(True, place[1:] > place[:-1] + s.length)
            starts = place[new]
            ends = np.append(place[np.flatnonzero(new)[1:] - 1], place[-1]) + s.length
            ranges[d] += zip(starts.tolist(), ends.tolist(), strict=True)
            items[d] |= set(s.items_of(pattern[a:b]).tolist())
    return words.counts, ranges, items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[int, bytes]]]:
    """Benchmark rows in blocks of bounded size, fetched one partition at a time."""
    block, size = [], 0
    for key, text in benchmark.select(benchmark[id_col].cast("long"), benchmark[text_col]).where(F.col(text_col).isNotNull()).toLocalIterator():
        raw = text.encode()
        if block and size + len(raw) > limit:
            yield block
            block, size = [], 0
        block.append((key, raw))
        size += len(raw)
    yield block


_TYPES = {"doc_id": pa.int64(), "n_words": pa.int64(), "hits": pa.list_(pa.list_(pa.int64())), "items": pa.list_(pa.int64())}
_SCHEMA = "doc_id long, n_words long, hits array<array<long>>, items array<long>"


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, hits (merged ranges of words, end exclusive) and items (ascending ids) of every text.

    A pass over the documents for each block of the benchmark; a later pass reads the rows that the one before it wrote, texts
    and hits together, so no rows need to be matched.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    state = rows.select("doc_id", "text", F.array().cast("array<array<long>>").alias("hits"), F.array().cast("array<long>").alias("items"))
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    block, i = next(blocks), 0
    while block is not None:
        following = next(blocks, None)
        sent, first, last = spark.sparkContext.broadcast((uuid.uuid4().hex, block)), i == 0, following is None

        def run(batches: Iterator[pa.RecordBatch], sent=sent, first=first, last=last) -> Iterator[pa.RecordBatch]:
            searchers = compiled(sent.value, window)
            names = ["doc_id"] if first else ["doc_id", "hits", "items"]
            keyed = (pa.RecordBatch.from_arrays([b.select(names).to_struct_array(), b.column("text")], names=["key", "text"]) for b in batches)
            for keys, texts in steps(keyed):
                n, ranges, items = search(searchers, texts)
                hits = [merged([*map(tuple, k.get("hits") or []), *r]) for k, r in zip(keys, ranges, strict=True)]
                every = [sorted({*(k.get("items") or []), *x}) for k, x in zip(keys, items, strict=True)]
                out = {"doc_id": [k["doc_id"] for k in keys], "n_words": n, "hits": hits, "items": every}
                yield record_batch(out, _TYPES) if last else record_batch({**out, "text": texts}, {**_TYPES, "text": pa.binary()})

        schema = _SCHEMA if last else _SCHEMA + ", text binary"
        found = state.mapInArrow(run, schema)
        if not last:
            found = written(found.withColumn("text", F.decode("text", "UTF-8")).drop("n_words"), "searched")
            if i:
                discard(state)
        state, block, i = found, following, i + 1
    return state


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, with all their columns, in which no benchmark window occurs; a pass for each block of the benchmark."""
    for i, block in enumerate(_blocks(benchmark, item_col, item_text_col, block_bytes)):
        sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, block))

        def verdicts(sent=sent):
            searchers = compiled(sent.value, window)
            return lambda texts: [not r for r in search(searchers, texts)[1]]

        # a pass ends before the next begins, so that a worker holds one block
        docs = filtered(written(docs, "searched") if i else docs, text_col, verdicts)
    return docs


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated from contamination()."""
    hit = F.expr("aggregate(hits, 0L, (n, r) -> n + r[1] - r[0])")
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def brute_force(texts: list[str | None], items: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple[int, int, int, str, bool]]:
    """What digests() must give, by comparing every window with every place."""
    import re

    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    out = []
    for text in texts:
        w, hit, found = split(text), set(), set()
        for item, t in items:
            p = split(t)
            size = min(window, len(p))
            for i in range(len(p) - size + 1 if size else 0):
                for j in range(len(w) - size + 1):
                    if w[j : j + size] == p[i : i + size]:
                        hit.update(range(j, j + size))
                        found.add(item)
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return out
