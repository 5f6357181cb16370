"""Scores of texts by a gated recurrent language model, beside the smoothed unigram model.

Counts: every word of the training documents is counted (by its 64-bit hash), with one end token a document. The VOCABULARY
most frequent words are the recurrent model's own; all others are its unknown word, which the counts divide among them and
one word never seen, so that a text's score is the logarithm of a proper probability.

Learning: every training document is read once. In a first round each task learns from an eighth of its documents (by a hash
of their id), in a second from the others, beginning from the round's common parameters; after a round the parameters are
averaged, weighted by the words learned from, in blocks that are summed by two shuffles (by block and salt, then by block). The
state runs through whole documents; gradients run through every window of it. Which documents a task learns from follows the
splits of the table, so the score of the same rows in other files differs by what tasks learn apart; the counts and base_score
do not.

Scoring: frequent words' counts (a bounded number) are sent to all tasks; the other words of a document are joined with the
counts. Long and short documents share lanes; the state of a document is carried to its end.

Defined results: a null or empty text is the end token alone; a row without an id is scored, and not learned from; without
training documents every probability is the prior's; repeated ids give repeated rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import steps, written
from latticework.llm.gru import END, Gru, laid_out, stream
from latticework.llm.words import words_of

VOCABULARY, CLASSES, RATE = 2046, 40, 0.3
#: Counted words sent to all tasks at most; tokens put into lanes at once; lanes when learning; parameters of a block.
FREQUENT, BUFFER, LEARN_LANES, BLOCK = 1 << 17, 3 << 19, 192, 1 << 13
FLUSH = 1 << 19
#: Shares that the sum of a block of parameters is computed in first.
SALTS = 64
#: Bits of a word's hash that lead to its place.
LEADING = 18
UNKNOWN = 1
#: Stands for the end token among the hashes of words.
END_HASH = np.int64(-0x61C8864680B583EB)


def _plain(docs: DataFrame, id_col: str, text_col: str, training: Callable[[Column], Column]) -> DataFrame:
    key = docs[id_col].cast("long")
    return docs.select(key.alias("doc_id"), docs[text_col].alias("text"), F.coalesce(training(key), F.lit(False)).alias("training"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(keys, hashes of all words, numbers of words) of steps of rows (key, text)."""
    for keys, texts in steps(batches):
        words = words_of(texts)
        yield keys, words.hashes().view(np.int64), words.counts


def word_counts(plain: DataFrame) -> DataFrame:
    """(word, n): how often each word, by its hash, occurs in the training documents, the end token included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def put_together() -> tuple[np.ndarray, np.ndarray]:
            words, n = (np.concatenate(x) for x in zip(*held, strict=True))
            unique, place = np.unique(words, return_inverse=True)
            return unique, np.bincount(place, weights=n, minlength=len(unique)).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            words, n = put_together()
            for i in range(0, len(words), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 100_000]), pa.array(n[i : i + 100_000])], names=["word", "n"])

        for keys, hashes, _ in _texts(batches):
            words, n = np.unique(hashes, return_counts=True)
            held.append((np.append(words, END_HASH), np.append(n, len(keys))))
            size += len(words)
            if size > FLUSH:
                held[:] = [put_together()]
                size = len(held[0][0])
                if size > FLUSH // 2:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    rows = plain.where("training").select("doc_id", "text").mapInArrow(count, "word long, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _top(counts: DataFrame, limit: int) -> list[tuple[int, int]]:
    """The words over the least count that leaves at most limit of them, by falling count."""
    by_size = {r["size"]: r["k"] for r in counts.groupBy(F.floor(F.log2("n") * 16).alias("size")).agg(F.count("*").alias("k")).collect()}
    total, least = 0, None
    for size in sorted(by_size, reverse=True):
        if total + by_size[size] > limit:
            break
        total, least = total + by_size[size], size
    if least is None:
        return []
    rows = counts.where(F.floor(F.log2("n") * 16) >= least).select("word", "n").toLocalIterator()
    return sorted(((r["word"], r["n"]) for r in rows), key=lambda x: (-x[1], x[0]))


class Vocabulary:
    """The model's own words, and the counts that are sent along."""

    def __init__(self, frequent: list[tuple[int, int]], tokens: int, distinct: int, ends: int, size: int = VOCABULARY) -> None:
        self.tokens, self.distinct, self.ends = tokens, distinct, ends
        words = [(w, n) for w, n in frequent if w != END_HASH]
        own = words[:size]
        order = sorted(range(len(words)), key=lambda i: words[i][0])
        self.words = np.array([words[i][0] for i in order], np.int64)
        self.counts = np.array([words[i][1] for i in order], np.int64)
        self.ids = np.array([2 + i if i < len(own) else UNKNOWN for i in order], np.int32)
        #: Model words by place, and the unknown one at -1; the place of the first word of each leading bits.
        self.known = np.append(self.ids, UNKNOWN).astype(np.uint16)
        self.first = np.searchsorted(self._leading(self.words), np.arange((1 << LEADING) + 1)).astype(np.int32)
        inside = ends + sum(n for _, n in own)
        #: Occurrences and distinct words (and one never seen) of the unknown word.
        self.rest, self.rest_words = tokens - inside, max(0, distinct - len(own) - (1 if ends else 0)) + 1
        self.model_counts = np.array([ends, self.rest, *(n for _, n in own)], np.int64)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Places of words among those sent along, -1 for others."""
        out = np.full(len(hashes), -1)
        leading = self._leading(hashes)
        at, end = self.first[leading], self.first[1:][leading]
        left = np.flatnonzero(at < end)
        at, end, hashes = at[left], end[left], hashes[left]
        while len(left):  # the words of the same leading bits, one after another: there are few
            same = self.words[at] == hashes
            out[left[same]] = at[same]
            at += 1
            more = np.flatnonzero(~same & (at < end))
            left, at, end, hashes = left[more], at[more], end[more], hashes[more]
        return out

    @staticmethod
    def _leading(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> (64 - LEADING)) + (1 << (LEADING - 1))

    @property
    def base_room(self) -> float:
        return math.log10(self.tokens + 0.1 * (self.distinct + 1))

    @property
    def rest_room(self) -> float:
        return math.log10(self.rest + 0.1 * self.rest_words)


def _buffers(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, each: Callable | None = None) -> Iterator[tuple[list, np.ndarray, np.ndarray, list] | pa.RecordBatch]:
    """(keys, model words with the end of each document, lengths, what each() returned by step), by bounded size.

    each(keys, places, hashes, numbers of words) gives (what to keep, record batches); the batches are passed on at once.
    """
    keys, ids, lengths, kept, size = [], [], [], [], 0
    for k, hashes, counts in _texts(batches):
        at = vocabulary.places(hashes)
        known = vocabulary.known[at]
        keys += k
        ids.append(np.insert(known, np.cumsum(counts), END))
        lengths.append(counts + 1)
        if each:
            own, out = each(k, at, hashes, counts)
            kept.append(own)
            yield from out
        size += len(hashes) + len(k)
        if size > BUFFER:
            yield keys, np.concatenate(ids), np.concatenate(lengths), kept
            keys, ids, lengths, kept, size = [], [], [], [], 0
    if keys:
        yield keys, np.concatenate(ids), np.concatenate(lengths), kept


def learned(plain: DataFrame, vocabulary: Vocabulary) -> Gru:
    """The recurrent model after both rounds."""
    spark = plain.sparkSession
    model = Gru(vocabulary.model_counts, CLASSES)
    shapes = {name: v.shape for name, v in model.p.items()}
    part = F.pmod(F.xxhash64("doc_id"), F.lit(8))
    for chosen in (part == 0, part != 0):
        sent = spark.sparkContext.broadcast((vocabulary, model))

        def learn(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            words, common = sent.value
            own = Gru.__new__(Gru)
            own.__dict__.update(common.__dict__, p={k: v.copy() for k, v in common.p.items()})
            seen = 0
            for _, ids, _, _ in _buffers(batches, words):
                seen += own.train(stream(ids, LEARN_LANES), RATE)
            if seen:
                flat = np.concatenate([own.p[n].ravel() for n in shapes]).astype(np.float64)
                starts = range(0, len(flat), BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(starts)), pa.int32()), pa.array([seen] * len(starts), pa.int64()), pa.array([(flat[i : i + BLOCK] * seen).tobytes() for i in starts], pa.binary())], names=["block", "seen", "sum"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Sums of the rows of each block in a task; applied to every block's salted shares, then to their sums."""
            sums: dict[int, list] = {}
            for b in batches:
                for block, seen, raw in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    v = np.frombuffer(raw, np.float64)
                    if block in sums:
                        sums[block][0] += seen
                        sums[block][1] += v
                    else:
                        sums[block] = [seen, v.copy()]
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s for s, _ in sums.values()], pa.int64()), pa.array([v.tobytes() for _, v in sums.values()], pa.binary())], names=["block", "seen", "sum"])

        schema = "block int, seen long, sum binary"
        made = plain.where(F.col("training") & chosen).select("doc_id", "text").mapInArrow(learn, schema)
        # as many rows as the model has blocks come to the driver
        shares = written(made.withColumn("salt", F.spark_partition_id() % SALTS), "learned").repartition("block", "salt").drop("salt").mapInArrow(add, schema)
        rows = shares.repartition("block").mapInArrow(add, schema).collect()
        if rows:
            total: dict[int, tuple[int, np.ndarray]] = {r["block"]: (r["seen"], np.frombuffer(r["sum"], np.float64)) for r in rows}
            flat = np.concatenate([total[k][1] / total[k][0] for k in sorted(total)]).astype(np.float32)
            at = 0
            for name, shape in shapes.items():
                n = int(np.prod(shape))
                model.p[name] = flat[at : at + n].reshape(shape).copy()
                at += n
    return model


def scores(docs: DataFrame, training: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text."""
    spark = docs.sparkSession
    plain = _plain(docs, id_col, text_col, training)
    counts = written(word_counts(plain), "word_counts")
    whole = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("word") == int(END_HASH), F.col("n"))).alias("ends")).first()
    vocabulary = Vocabulary(_top(counts, FREQUENT), whole["n"] or 0, whole["v"], whole["ends"] or 0)
    model = learned(plain, vocabulary)
    sent = spark.sparkContext.broadcast((vocabulary, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row with the sums over the words known here, and one for each distinct other word of a document."""
        words, gru = sent.value
        log_count = np.append(np.log10(words.counts + 0.1), 0.0)
        counted, unknown = np.append(np.ones(len(words.counts)), 0.0), np.append((words.ids == UNKNOWN).astype(float), 0.0)
        def counted_words(keys: list, at: np.ndarray, hashes: np.ndarray, n: np.ndarray) -> tuple[tuple, list[pa.RecordBatch]]:
            m = len(keys)
            doc = np.repeat(np.arange(m), n)
            # frequent words that the model does not know: their part of the unknown word is known here
            sums = [np.bincount(doc, w, m) for w in (log_count[at], counted[at], log_count[at] * unknown[at])]
            rare = np.flatnonzero(at < 0)
            rare = rare[np.lexsort((hashes[rare], doc[rare]))]
            out = []
            if len(rare):
                d, w = doc[rare], hashes[rare]
                new = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (w[1:] != w[:-1])))
                times, d, w = np.diff(np.append(new, len(rare))), d[new], w[new]
                row = np.array([k["row"] for k in keys], np.int64)
                for i in range(0, len(d), 50_000):
                    j = slice(i, i + 50_000)
                    k = len(d[j])
                    out.append(pa.RecordBatch.from_arrays([pa.array(row[d[j]]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.bool_()), pa.array(times[j]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64()), pa.array(w[j])], names=_PART))
            return tuple(sums), out

        keyed = (pa.RecordBatch.from_arrays([b.select(["row", "doc_id", "training"]).to_struct_array(), b.column("text")], names=["key", "text"]) for b in batches)
        for part in _buffers(keyed, words, counted_words):
            if isinstance(part, pa.RecordBatch):
                yield part
                continue
            keys, ids, lengths, kept = part
            lanes, place = laid_out(ids, lengths)
            first = np.cumsum(lengths) - lengths
            sums = np.add.reduceat(gru.score(lanes).ravel()[place], first, dtype=np.float64)
            base, known, rest = (np.concatenate([k[i] for k in kept]) for i in range(3))
            unknowns = np.add.reduceat((ids == UNKNOWN).astype(np.int64), first)
            score = sums + rest - unknowns * words.rest_room
            for i in range(0, len(keys), 10_000):
                j = slice(i, i + 10_000)
                part = keys[j]
                yield pa.RecordBatch.from_arrays([pa.array([x["row"] for x in part], pa.int64()), pa.array([x["doc_id"] for x in part], pa.int64()), pa.array([x["training"] for x in part], pa.bool_()), pa.array(lengths[j]), pa.array(known[j].astype(np.int64)), pa.array(base[j]), pa.array(score[j]), pa.nulls(len(part), pa.int64())], names=_PART)

    rows = plain.select(F.monotonically_increasing_id().alias("row"), "doc_id", "training", "text").mapInArrow(run, "row long, doc_id long, training boolean, n long, known long, base double, score double, word long")
    # the words that the tasks did not know, a row for each in a document, and its sums there, meet their counts
    rows = written(rows, "scored")
    other = rows.where("word IS NOT NULL").select("row", "n", "word").join(counts.select("word", F.col("n").alias("c")), "word", "left")
    log_c = F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))
    of_other = other.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("training"), F.lit(0).cast("long").alias("n"), F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0).cast("long").alias("known"), log_c.alias("base"), log_c.alias("score"))
    total = rows.where("word IS NULL").drop("word").unionByName(of_other).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("training").alias("training"), F.sum("n").alias("n_tokens"), F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("score").alias("score"))
    ends = 1 if vocabulary.ends else 0
    end_log = math.log10(vocabulary.ends + 0.1)
    return total.select(
        "doc_id", (~F.col("training")).alias("held_out"), "n_tokens", (F.col("known") + ends).cast("long").alias("n_known"), F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + end_log - F.col("n_tokens") * vocabulary.base_room).alias("base_score"), "score",
    )


_PART = ["row", "doc_id", "training", "n", "known", "base", "score", "word"]


def in_training(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 10 != 0


def brute_force_base(rows: list[tuple[int, str | None, bool]]) -> dict[int, tuple[int, int, int, float]]:
    """(n_tokens, n_known, train_tokens, base_score) of each id, from (id, text, training)."""
    from collections import Counter

    split = lambda t: [*(t or "").encode().lower().split(), None]
    c: Counter = Counter()
    for _, text, use in rows:
        if use:
            c.update(split(text))
    n, v = sum(c.values()), len(c)
    return {i: (len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for i, text, _ in rows for w in [split(text)]}
