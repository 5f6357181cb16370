"""Toxic passages by maximum-scoring segments.

Every word has a score: the log-odds of its features in toxic against clean documents, under a Dirichlet prior that has the
features' frequencies in the whole corpus. The features of a word are the word and its leading 4, 5 and 6 bytes (for
inflected forms that the labels lack); the most telling one counts, and a word without one lowers the score by a constant.
A linear-time scan finds all maximal segments of positive score. Their scores are calibrated by the extreme-value law of
Karlin and Altschul, fitted on clean documents, and the significant ones of a document are summed to its features, from
which a logistic model, fitted on other labelled documents than the word scores, gives the document's score.

Labelled documents used for fitting: the SAMPLE ones (a parameter) that come first by a hash of their id; the words'
corpus frequencies are over all documents. Every feature of at least LEAST toxic documents of the sample is counted, so what is
broadcast is bounded by the sample.

Defined results: a null or empty text has no segments and the score of such a document; without labelled documents of both
classes every score is the prior 0.05; repeated ids in the labels count as toxic if any row says so; repeated documents give
repeated rows, and count as often as they occur in the corpus frequencies, but once (the least of several texts) as labelled ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import filtered, record_batch, steps, written
from latticework.llm.words import ALNUM, Lookup, Words, mix, words_of

SAMPLE = 20_000
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3
#: Weight of the prior in documents, least number of toxic documents, least z of a feature, score of any other word.
PRIOR, LEAST, LEAST_Z, DRIFT = 100.0, 3, 2.5, -0.4
SIGNIFICANT = 0.05
#: Bins of segment scores in one unit; features that a task holds before it counts them.
BINS, FLUSH = 64, 1 << 22
_TAGS = np.array([0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x9B05688C2B3E6C1F, 0x510E527FADE682D1], np.uint64)


def features_of(words: Words) -> np.ndarray:
    """Hashes of the features of each word, a row each: the word, then its prefixes (0 where it is no longer than that)."""
    whole = words.hashes()
    cut = [whole ^ _TAGS[0]]
    for k, tag in zip(PREFIXES, _TAGS[1:], strict=True):
        longer = words.end - words.start > k
        h = np.zeros(len(whole), np.uint64)
        if longer.any():
            part = Words(words.data, words.start[longer], words.start[longer] + k, words.doc[longer], words.first)
            h[longer] = mix(part.hashes() ^ tag)
        cut.append(h)
    return np.stack(cut, 1)


def maximal_segments(places: list[int], scores: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first place, last place, score) of a text whose words score drift but for those given.

    The linear-time algorithm of Ruzzo and Tompa; a run of words that score drift is taken in one step.
    """
    stack: list[list[float]] = []  # [first, last, sum before it, sum after it]
    total, next_place = 0.0, 0
    for place, score in zip(places, scores, strict=True):
        total += drift * (place - next_place)
        next_place = place + 1
        if score <= 0:
            total += score
            continue
        new = [place, place, total, total + score]
        total += score
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j -= 1
            if j < 0 or stack[j][3] >= new[3]:
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
    return [(int(a), int(b), s1 - s0) for a, b, s0, s1 in stack]


class Model:
    """Word scores, the extreme-value law and the logistic weights."""

    def __init__(self, keys: np.ndarray, scores: np.ndarray) -> None:
        self.keys, self.scores = keys, scores
        self.decay, self.scale = 1.0, 0.1
        self.weights: np.ndarray | None = None

    def segments(self, texts: list[bytes]) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Number of words, and maximal segments, of each text."""
        words = words_of(texts, ALNUM)
        out: list[list[tuple[int, int, float]]] = [[] for _ in texts]
        if len(words.start) and len(self.keys):
            if not hasattr(self, "lookup"):
                self.lookup = Lookup(self.keys)
            at = self.lookup.places(features_of(words))
            told = np.flatnonzero((at >= 0).any(1))
            value = np.where(at[told] >= 0, self.scores[at[told]], 0.0)
            best = value[np.arange(len(told)), np.abs(value).argmax(1)]
            doc = words.doc[told]
            place = told - words.first[doc]
            borders = np.flatnonzero(np.diff(doc, prepend=-1, append=len(texts)))
            for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
                out[int(doc[a])] = maximal_segments(place[a:b].tolist(), best[a:b].tolist())
        return words.counts, out

    def features(self, n: int, segments: list[tuple[int, int, float]]) -> list[float]:
        """1, the best segment's and all significant segments' calibrated scores, their number, and the text's length."""
        room = math.log(max(self.scale * max(n, 1), 1e-9))
        bits = [self.decay * s - room for _, _, s in segments]
        good = [b for b in bits if self.p_value(b) <= SIGNIFICANT]
        best = min(30.0, max([-5.0, *bits])) if bits else -5.0
        return [1.0, best / 5, math.log1p(sum(good)) if good else 0.0, math.log1p(len(good)), math.log1p(n) / 5, float(best > 3)]

    @staticmethod
    def p_value(bits: float) -> float:
        return -math.expm1(-math.exp(min(50.0, -bits)))

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(features), 0.05)
        return 1 / (1 + np.exp(-np.clip(features @ self.weights, -30, 30)))

    def calibrate(self, words: int, scores: list[tuple[int, int, float]]) -> None:
        """Fits the law to the segments of clean documents of so many words, from (bin, number, sum) of their scores."""
        scores = sorted(scores)
        n = sum(k for _, k, _ in scores)
        if words and n >= 20:
            # number of segments over s in n words: scale * n * exp(-decay * s); decay from the mean excess over the median's bin
            seen, at = 0, 0
            while 2 * (seen + scores[at][1]) < n:
                seen += scores[at][1]
                at += 1
            base, over = scores[at][0] / BINS, sum(k for _, k, _ in scores[at:])
            excess = sum(x for _, _, x in scores[at:]) / over - base
            self.decay = float(np.clip(1 / max(excess, 1e-3), 0.2, 3.0))
            self.scale = float((over + 0.5) / words * math.exp(self.decay * base))
        else:
            self.decay, self.scale = 1.0, (n + 0.5) / (words + 1.0) * math.e

    def weigh(self, rows: list[tuple[list[float], int]]) -> None:
        """Fits the logistic weights, from (features, toxic) of documents."""
        if len({y for _, y in rows}) < 2:
            self.weights = None
            return
        x, y = (np.array(v, float) for v in zip(*rows, strict=True))
        w = np.zeros(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * 0.1
            w += np.clip(np.linalg.solve(h, x.T @ (y - p) - 0.1 * w), -2, 2)
        self.weights = w


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))


def fit(docs: DataFrame, labels: DataFrame, use: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from the labelled documents whose id passes use() (a bounded sample) and the corpus counts."""
    spark = docs.sparkSession
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull())
    known = known.where(use(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = known.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample).collect()
    # three quarters for the words' scores, one for the calibration
    role = {r["doc_id"]: (2 if r["h"] % 4 else 0) + (1 if r["y"] else 0) for r in chosen}
    plain = _plain(docs, id_col, text_col)
    # at most as many ids as the sample, each of them once
    wanted = F.broadcast(spark.createDataFrame(list(role.items()), "doc_id long, role int"))
    sampled = written(plain.join(wanted, "doc_id").groupBy("doc_id", "role").agg(F.min("text").alias("text")).select("doc_id", "role", "text"), "labelled")

    def toxic_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []
        for _, texts in steps(batches):
            words = words_of(texts, ALNUM)
            f = features_of(words)
            seen += [u[u != 0] for a, b in zip(words.first[:-1], words.first[1:], strict=True) if len(u := np.unique(f[a:b]))]
            if sum(map(len, seen)) > FLUSH:
                yield from counted(seen)
                seen = []
        if seen:
            yield from counted(seen)

    def counted(seen: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, n = np.unique(np.concatenate(seen), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

    # bounded by the sample's toxic documents
    frequent = sampled.where("role = 3").select("doc_id", "text").mapInArrow(toxic_features, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST).select("key").collect()
    keys = np.sort(np.array([r["key"] for r in frequent], np.int64).view(np.uint64))
    sent = spark.sparkContext.broadcast(keys)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, n): in how many documents each feature is; the number of documents under key -1."""
        lookup, m = Lookup(sent.value), len(sent.value)
        total, n_docs = np.zeros(m, np.int64), 0
        for _, texts in steps(batches):
            words = words_of(texts, ALNUM)
            n_docs += len(texts)
            at = lookup.places(features_of(words))
            word, _ = np.nonzero(at >= 0)
            total += np.bincount(np.unique(words.doc[word] * m + at[at >= 0]) % m, minlength=m)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n_docs))], names=["key", "n"])

    def counted_in(rows: DataFrame) -> tuple[np.ndarray, int]:
        # as many rows as there are features, and one
        found = rows.select("doc_id", "text").mapInArrow(counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
        n = np.zeros(len(keys))
        for r in found:
            if r["key"] >= 0:
                n[r["key"]] = r["n"]
        return n, sum(r["n"] for r in found if r["key"] < 0)

    model = Model(np.zeros(0, np.uint64), np.zeros(0))
    if len(keys):
        (corpus, n_docs), (toxic, n_toxic), (clean, n_clean) = (counted_in(d) for d in (plain, sampled.where("role = 3"), sampled.where("role = 2")))
        if n_clean and n_toxic:
            share = PRIOR * corpus / n_docs + 0.01
            odds = lambda y, n: np.log((y + share) / (n + PRIOR + 0.02 - y - share))
            delta = odds(toxic, n_toxic) - odds(clean, n_clean)
            z = delta / np.sqrt(1 / (toxic + share) + 1 / (clean + share))
            keep = (z >= LEAST_Z) & (delta > -DRIFT)
            model = Model(keys[keep], np.minimum(delta[keep], 6.0))
    fitted = spark.sparkContext.broadcast(model)

    def clean_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(bin, n, sum): number and sum of segment scores by bin; the number of words under bin -1."""
        n_words, bins = 0, {}
        for _, texts in steps(batches):
            counts, segs = fitted.value.segments(texts)
            n_words += int(counts.sum())
            for _, _, x in (s for found in segs for s in found):
                k = int(x * BINS)
                n, total = bins.get(k, (0, 0.0))
                bins[k] = n + 1, total + x
        yield record_batch({"bin": [-1, *bins], "n": [n_words, *(n for n, _ in bins.values())], "sum": [0.0, *(x for _, x in bins.values())]}, {"bin": pa.int64(), "n": pa.int64(), "sum": pa.float64()})

    # scores are bounded by the best score times the words of the longest text of the sample; their bins come to the driver
    found = sampled.where("role = 0").select("doc_id", "text").mapInArrow(clean_segments, "bin long, n long, sum double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum")).collect()
    model.calibrate(sum(r["n"] for r in found if r["bin"] < 0), [(r["bin"], r["n"], r["sum"]) for r in found if r["bin"] >= 0])
    lawful = spark.sparkContext.broadcast(model)

    def sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in steps(batches):
            counts, segs = lawful.value.segments(texts)
            yield record_batch({"x": [lawful.value.features(n, s) for n, s in zip(counts.tolist(), segs, strict=True)], "y": keys}, {"x": pa.list_(pa.float64()), "y": pa.int64()})

    # at most as many rows as the sample, of six numbers
    got = sampled.where("role < 2").select(F.col("role").cast("long").alias("y"), "text").mapInArrow(sample_features, "x array<double>, y long").collect()
    model.weigh(sorted((list(r["x"]), r["y"]) for r in got))
    return model


_TYPES = {"doc_id": pa.int64(), "score": pa.float64(), "segments": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("p_value", pa.float64())]))}


def toxic_passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and segments (significant ones, by words, end exclusive) of every text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for ids, texts in steps(batches):
            counts, segs = m.segments(texts)
            rows = [m.features(n, s) for n, s in zip(counts.tolist(), segs, strict=True)]
            found = []
            for n, s in zip(counts.tolist(), segs, strict=True):
                room = math.log(max(m.scale * max(n, 1), 1e-9))
                found.append([{"start": a, "end": b + 1, "score": x, "p_value": p} for a, b, x in s if (p := m.p_value(m.decay * x - room)) <= SIGNIFICANT])
            yield record_batch({"doc_id": ids, "score": m.score(np.array(rows)), "segments": found}, _TYPES)

    return _plain(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, segments array<struct<start:bigint,end:bigint,score:double,p_value:double>>")


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, whose score is below the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def verdicts() -> Callable[[list[bytes]], list[bool]]:
        def keep(texts: list[bytes]) -> list[bool]:
            counts, segs = sent.value.segments(texts)
            return (sent.value.score(np.array([sent.value.features(n, s) for n, s in zip(counts.tolist(), segs, strict=True)])) < threshold).tolist()

        return keep

    return filtered(docs, text_col, verdicts)


def in_training(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 != 2
