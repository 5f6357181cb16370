"""SentencePiece encoding and decoding over a relational lattice.

A text falls into atoms: stretches that no piece can cross (at a space, at a character without a piece, between two
characters that stand together in no piece). The distinct atoms of the corpus are encoded relationally: their substrings of
bounded length are exploded and equi-joined with the piece table, the matching edges are grouped by atom, and a higher-order
aggregate folds each atom's lattice. Atoms arrive partitioned by their text, which the explosion keeps, so the grouping
needs no further shuffle.

The fold follows the kind of the model. For a unigram model it is Viterbi's: the best sum of scores by end position. The
best path is not what a BPE model means, whose library merges greedily; there the fold replays the merges on the lattice:
each step takes the edge of the best score (then the leftmost) that spans exactly two present symbols, until none is left.

Frequent atoms (a bounded number, by a threshold on their counts) are sent to all tasks, the occurrences of the others are
joined with the encoded atoms. Characters without a piece are encoded by their bytes where they stand. Atoms of over MAX_ATOM
characters, whose borders a number has no bits for, are encoded where they stand too, by the same merging order or the same
best sum.

Defined results: null and empty texts have no pieces and round-trip to the empty text; U+2581 in a text decodes as a space,
as with the library; repeated ids give repeated rows.
"""

from __future__ import annotations

import contextlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.llm.common import steps, trim, written
from latticework.llm.words import Lookup, _powers, mix

SPACE = "▁"
MAX_ATOM = 60
#: Atoms that are sent to all tasks, at most.
FREQUENT = 1 << 17
#: Distinct atoms that a task counts, or remembers, before it starts anew.
FLUSH = 150_000
#: Code points below which pieces of one character are looked up in an array.
SINGLES = 0x3000
#: Bytes of text cut at once.
STEP = 1 << 19


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer's message, for varints and byte strings."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = message[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(message):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            n = varint()
            yield tag >> 3, message[i : i + n]
            i += n
        else:
            i += 8 if tag & 7 == 1 else 4


#: Kinds of models, as the trainer's part of a model file numbers them.
UNIGRAM, BPE = 1, 2


class PieceModel:
    """Pieces, scores and kind (UNIGRAM or BPE; others are refused) of a SentencePiece model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        trainer = next((v for k, v in _fields(sp.serialized_model_proto()) if k == 2), b"")
        self.kind = next((v for k, v in _fields(trainer) if k == 3), UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError(f"{path}: neither a unigram nor a BPE model")
        self.pieces: dict[str, tuple[int, float]] = {}
        self.byte_ids: dict[int, int] = {}
        for i in range(len(sp)):
            if sp.is_byte(i):
                self.byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.pieces[sp.id_to_piece(i)] = (i, float(sp.get_score(i)))
        self.unknown = sp.unk_id()
        self.longest = max(map(len, self.pieces))
        outputs = [b""] * (len(sp) + 1)  # the last for an id that is missing, -1
        for piece, (i, _) in self.pieces.items():
            outputs[i] = piece.replace(SPACE, " ").encode()
        for byte, i in self.byte_ids.items():
            outputs[i] = bytes([byte])
        #: What ids decode to, end to end.
        self.data = np.frombuffer(b"".join(outputs), np.uint8)
        self.length = np.array([len(o) for o in outputs], np.int64)
        #: Characters of each piece; the bytes of a character have none.
        self.chars = np.zeros(len(sp) + 1, np.int64)
        for piece, (i, _) in self.pieces.items():
            self.chars[i] = len(piece)
        self.first = np.cumsum(self.length) - self.length

    def decoded(self, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """The bytes that lists of ids (flat, with the lists' sizes) decode to; spaces are still leading."""
        size = self.length[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(ends[-1]) + np.repeat(self.first[ids] - ends[:-1], size)
        offsets = ends[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(self.data[at])])

    def direct(self, atom: str) -> list[int] | None:
        """Ids of an atom that stays out of the lattice, else None."""
        if len(atom) == 1 and atom not in self.pieces:
            return [self.byte_ids.get(b, self.unknown) for b in atom.encode()] if self.byte_ids else [self.unknown]
        if len(atom) <= MAX_ATOM:
            return None
        return self.best(atom) if self.kind == UNIGRAM else self.greedy(atom)

    def best(self, atom: str) -> list[int]:
        """Viterbi's path through an atom of any length; ties go to the longer last piece, as in viterbi_fold()."""
        cost, back = [0.0], [(0, 0)]
        for end in range(1, len(atom) + 1):
            into = [(cost[at] - found[1], at, found[0]) for at in range(max(0, end - self.longest), end) if cost[at] < np.inf and (found := self.pieces.get(atom[at:end]))]
            least = min(into, default=(np.inf, 0, 0))
            cost.append(least[0])
            back.append(least[1:])
        out, end = [], len(atom)
        while end:
            end, i = back[end]
            out.append(i)
        return out[::-1]

    def greedy(self, atom: str) -> list[int]:
        """Merges by a queue of neighbours, for atoms of any length."""
        n = len(atom)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        queue: list[tuple[float, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and end[j] - i <= self.longest and (found := self.pieces.get(atom[i : end[j]])):
                heapq.heappush(queue, (-found[1], i, end[j]))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, e = heapq.heappop(queue)
            j = after[i] if alive[i] else n
            if j >= n or not alive[j] or end[j] != e:
                continue
            alive[j] = False
            end[i], after[i] = e, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [self.pieces[atom[i : end[i]]][0] for i in range(n) if alive[i]]

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, id, score, hex): bounded by the vocabulary. hex: the bytes that the piece decodes to."""
        rows = [(p, i, s, p.replace(SPACE, " ").encode().hex()) for p, (i, s) in self.pieces.items()] + [(None, i, 0.0, f"{b:02x}") for b, i in self.byte_ids.items()]
        return spark.createDataFrame(rows, "piece string, id int, score double, hex string")


def merge_fold(edges: Column, length: Column, atom: Column, singles: Column) -> Column:
    """Ids of a BPE atom from its edges array<struct<rank,at,n,id,ends,span>>.

    Borders of symbols are bits of a number; ends and span are an edge's first and last bit, and all its bits. An edge can be
    merged if its ends are borders with one more between them. Edges whose ends are gone are dropped on the way. singles has
    the pieces of one character by code point; those of code points beyond it are edges.
    """
    Edge = "array<struct<rank:double,at:int,n:int,id:int,ends:bigint,span:bigint>>"

    def step(state: Column, _: Column) -> Column:
        def merged(best: Column) -> Column:
            left = state["m"].bitwiseAND(F.bitwise_not(best["span"].bitwiseXOR(best["ends"])))
            return F.transform(F.array(left), lambda m: F.struct(m.alias("m"), F.filter(state["edges"], lambda e: (m.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(m.bitwiseAND(e["span"])) > 2)).alias("edges")))

        best = F.array_min(F.filter(state["edges"], lambda e: F.bit_count(state["m"].bitwiseAND(e["span"])) == 3))
        return F.when(F.size(state["edges"]) == 0, state).otherwise(F.coalesce(F.get(F.flatten(F.transform(F.filter(F.array(best), lambda b: b.isNotNull()), merged)), F.lit(0)), F.struct(state["m"].alias("m"), F.array().cast(Edge).alias("edges"))))

    every = F.call_function("shiftleft", F.lit(1).cast("long"), length + 1) - 1
    mask = F.aggregate(F.sequence(F.lit(1), F.greatest(length - 1, F.lit(1))), F.struct(every.alias("m"), F.filter(edges, lambda e: e["n"] > 1).alias("edges")), step, lambda x: x["m"])
    point = lambda at: F.ascii(F.substring(atom, at + 1, F.lit(1)))

    def final(m: Column) -> Column:
        alone = F.filter(F.sequence(F.lit(0), length - 1), lambda at: (F.call_function("shiftright", m, at).bitwiseAND(F.lit(3)) == 3) & (point(at) < SINGLES))
        chosen = F.filter(edges, lambda e: (m.bitwiseAND(e["span"]) == e["ends"]) & ((e["n"] > 1) | (point(e["at"]) >= SINGLES)))
        every = F.concat(F.transform(alone, lambda at: F.struct(at.alias("at"), F.get(singles, point(at)).alias("id"))), F.transform(chosen, lambda e: F.struct(e["at"].alias("at"), e["id"].alias("id"))))
        return F.transform(F.array_sort(every), lambda e: e["id"])

    return F.get(F.transform(F.array(mask), final), F.lit(0))


def viterbi_fold(edges: Column, length: Column) -> Column:
    """Ids of the path of the best sum of scores, from edges array<struct<rank,at,n,id>> (rank: score negated).

    The state is the best path to each end position so far; ties go to the longer last edge. (The library adds in single
    precision over a whole text, and may choose another of several paths whose sums are equal but for that.)
    """
    state = "array<struct<cost:double,ids:array<int>>>"

    def step(best: Column, end: Column) -> Column:
        into = F.transform(F.filter(edges, lambda e: (e["at"] + e["n"] == end) & F.get(best, e["at"])["ids"].isNotNull()), lambda e: F.struct((F.get(best, e["at"])["cost"] + e["rank"]).alias("cost"), e["at"].alias("at"), e["id"].alias("id")))
        found = F.get(F.transform(F.array(F.array_min(into)), lambda x: F.when(x.isNotNull(), F.struct(x["cost"].alias("cost"), F.concat(F.get(best, x["at"])["ids"], F.array(x["id"])).alias("ids")))), F.lit(0))
        return F.concat(best, F.array(found).cast(state))

    start = F.array(F.struct(F.lit(0.0).alias("cost"), F.array().cast("array<int>").alias("ids"))).cast(state)
    return F.when(length > 0, F.get(F.aggregate(F.sequence(F.lit(1), F.greatest(length, F.lit(1))), start, step), length)["ids"]).otherwise(F.array().cast("array<int>"))


def encode_atoms(atoms: DataFrame, pieces: DataFrame, longest: int, unigram: bool = False) -> DataFrame:
    """atoms (atom, and other columns) with ids; distinct atoms of at most MAX_ATOM characters."""
    others = [c for c in atoms.columns if c != "atom"]
    # all atoms of a partition stay there: explode, a broadcast join of the bounded piece table, and grouping by the same key
    starts = atoms.withColumn("at", F.explode(F.sequence(F.lit(0), F.length("atom") - 1)))
    # single characters come from an array; one edge of them stays, so that every atom has a row
    least = F.lit(1) if unigram else F.when((F.col("at") == 0) | (F.ascii(F.substring("atom", F.col("at") + 1, F.lit(1))) >= SINGLES), 1).otherwise(2)
    most = F.least(F.lit(longest), F.length("atom") - F.col("at"))
    spans = starts.withColumn("n", F.explode(F.when(most >= least, F.sequence(least, most))))
    order = Window.orderBy(F.desc("score"))  # over the bounded piece table
    known = pieces.where("piece IS NOT NULL").select(F.col("piece").alias("p"), "id", "score", F.dense_rank().over(order).cast("long").alias("rank"))
    joined = spans.join(F.broadcast(known), F.substring("atom", F.col("at") + 1, F.col("n")) == F.col("p"))
    first = [F.first(c).alias(c) for c in others]
    if unigram:
        paths = joined.groupBy("atom").agg(*first, F.collect_list(F.struct((-F.col("score")).alias("rank"), "at", "n", "id")).alias("edges"))
        return paths.select("atom", *others, viterbi_fold(F.col("edges"), F.length("atom")).alias("ids"))
    # an edge is one number, in the order of rank, then place: small to group and sort
    code = F.shiftleft("rank", 36).bitwiseOR(F.shiftleft(F.col("at").cast("long"), 30)).bitwiseOR(F.shiftleft(F.col("n").cast("long"), 24)).bitwiseOR(F.col("id"))
    # bounded by SINGLES
    by_point = {ord(r["piece"]): r["id"] for r in pieces.where(f"length(piece) = 1 AND ascii(piece) < {SINGLES}").select("piece", "id").collect()}
    singles = F.split(F.lit(",".join(str(by_point.get(i, -1)) for i in range(max([0, *by_point]) + 1))), ",").cast("array<int>")  # folded to a constant
    grouped = joined.select("atom", *others, code.alias("code")).groupBy("atom").agg(*first, F.collect_list("code").alias("codes"))
    one = F.lit(1).cast("long")

    def unpacked(c: Column) -> Column:
        at, n = F.shiftright(c, 30).bitwiseAND(F.lit(63)).cast("int"), F.shiftright(c, 24).bitwiseAND(F.lit(63)).cast("int")
        ends = F.call_function("shiftleft", one, at).bitwiseOR(F.call_function("shiftleft", one, at + n))
        span = F.call_function("shiftleft", F.call_function("shiftleft", one, n + 1) - 1, at)
        return F.struct(F.shiftright(c, 36).cast("double").alias("rank"), at.alias("at"), n.alias("n"), c.bitwiseAND(F.lit((1 << 24) - 1)).cast("int").alias("id"), ends.alias("ends"), span.alias("span"))

    return grouped.select("atom", *others, merge_fold(F.transform("codes", unpacked), F.length("atom"), F.col("atom"), singles).alias("ids"))


def decode(encoded: DataFrame, pieces: DataFrame, key: str, ids_col: str = "ids") -> DataFrame:
    """(key, decoded): ids joined back to the piece table, their bytes put together in order; spaces are still leading."""
    parts = encoded.select(key, F.posexplode(ids_col).alias("pos", "id")).join(F.broadcast(pieces.select("id", "hex")), "id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "hex"))), lambda x: x["hex"]), "")
    return parts.groupBy(key).agg(F.decode(F.unhex(text), "UTF-8").alias("decoded"))


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


@contextlib.contextmanager
def _grouped_in_memory(spark: SparkSession, groups: int = 1 << 17) -> Iterator[None]:
    """Lists of so many groups are collected without a sort, which at some 500 bytes an atom is 64 MB a task; then it sorts."""
    key = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, str(groups))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def dictionary(plain: DataFrame, model: PieceModel, pieces: DataFrame) -> DataFrame:
    """(atom, count, ids, exact) of every atom of the corpus; exact: its ids decode to the atom."""
    sent = plain.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(sent.value)
        held: list[tuple[np.ndarray, np.ndarray, list[str]]] = []

        def put_together() -> tuple[np.ndarray, np.ndarray, list[str]]:
            hashes, n = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            strings = [s for x in held for s in x[2]]
            unique, first, place = np.unique(hashes, return_index=True, return_inverse=True)
            return unique, np.bincount(place, weights=n).astype(np.int64), [strings[i] for i in first.tolist()]

        def out() -> Iterator[pa.RecordBatch]:
            _, n, strings = put_together()
            held.clear()
            for i in range(0, len(n), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(strings[i : i + 50_000], pa.string()), pa.array(n[i : i + 50_000])], names=["atom", "n"])

        keyed = (pa.RecordBatch.from_arrays([pa.nulls(b.num_rows), b.column(0)], names=["key", "text"]) for b in batches)
        size = 0
        for _, texts in steps(keyed, STEP):
            atoms = cutter.cut([t.decode() for t in texts])
            inside = np.flatnonzero((atoms.single == 0) & (atoms.end - atoms.start <= MAX_ATOM))
            hashes, first, n = np.unique(atoms.hashes[inside], return_index=True, return_counts=True)
            held.append((hashes, n, atoms.strings(inside[first])))
            size += len(n)
            if size > 2 * FLUSH:
                held[:] = [put_together()]
                size = len(held[0][1])
                if size > FLUSH:
                    yield from out()
                    size = 0
        if held:
            yield from out()

    def decoding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            back = sent.value.decoded(pc.fill_null(ids.flatten(), -1).to_numpy(), ids.value_lengths().to_numpy())
            exact = pc.equal(back, pc.replace_substring(b.column("atom"), SPACE, " ").cast(pa.binary()))
            yield pa.RecordBatch.from_arrays([*b.columns, exact], names=["atom", "count", "ids", "exact"])

    atoms = plain.select("text").mapInArrow(count, "atom string, n long").groupBy("atom").agg(F.sum("n").alias("count"))
    with _grouped_in_memory(plain.sparkSession):
        return written(encode_atoms(atoms, pieces, model.longest, model.kind == UNIGRAM).select("atom", "count", "ids").mapInArrow(decoding, "atom string, count long, ids array<int>, exact boolean"), "atoms")


class Known:
    """The atoms that are sent to all tasks, packed: their texts, and their ids end to end."""

    def __init__(self, rows: list) -> None:
        self.texts = "\n".join(r["atom"] for r in rows)  # no piece has a line break
        self.sizes = np.array([len(r["ids"]) for r in rows], np.int16)
        self.ids = np.fromiter((i for r in rows for i in r["ids"]), np.int32)
        self.exact = np.array([r["exact"] for r in rows], bool)


def frequent(words: DataFrame, limit: int = FREQUENT) -> Known:
    """The atoms over the least count that leaves at most limit of them."""
    by_size = {r["size"]: r["n"] for r in words.groupBy(F.floor(F.log2("count") * 8).alias("size")).agg(F.count("*").alias("n")).collect()}
    total, least = 0, None
    for size in sorted(by_size, reverse=True):
        if total + by_size[size] > limit:
            break
        total, least = total + by_size[size], size
    return Known(words.where(F.floor(F.log2("count") * 8) >= least).select("atom", "ids", "exact").collect() if least is not None else [])


#: Codes of texts are sums, modulo 2^64, of a number for each id times BASE to the power of its piece's place in the marked text.
BASE = np.uint64(0x9E3779B97F4A7C15)


def _codes(ids: np.ndarray, sizes: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """A number for each list of ids (flat, with the lists' sizes, none 0) of one atom, from ids, places and bytes' order."""
    if not len(ids):
        return np.zeros(0, np.uint64)
    first = np.cumsum(sizes) - sizes
    n = chars[ids]
    before = np.cumsum(n) - n
    place = (before - np.repeat(before[first], sizes)).astype(np.uint64)
    # bytes of one character share its place and are told apart by their order, which is that in their atom
    order = np.where(n == 0, np.arange(len(ids)) - np.repeat(first, sizes), 0).astype(np.uint64)
    return np.add.reduceat(_placed(mix(ids.astype(np.uint64) + (order << np.uint64(32)) + np.uint64(1)), place), first)


def _placed(codes: np.ndarray, places: np.ndarray) -> np.ndarray:
    return codes * np.power(BASE, places.astype(np.uint64))


def ids_code(ids: list[int], model: PieceModel) -> int:
    """The code of one text's ids, as piece_digests() gives it: what another encoder's ids are compared by."""
    x = np.array(ids, np.int64)
    if not len(x):
        return 0
    n = model.chars[x]
    # a character of bytes takes one place; a new one begins after a piece, or with a byte that leads a sequence
    lead = (n == 0) & np.array([not 0x80 <= model.data[f] < 0xC0 for f in model.first[x]])
    steps_ = np.where(n > 0, n, lead)
    start = (n > 0) | lead
    place = (np.cumsum(steps_) - steps_)[start][np.cumsum(start) - 1]
    order = np.where(n == 0, np.arange(len(x)) - np.flatnonzero(start)[np.cumsum(start) - 1], 0).astype(np.uint64)
    code = int(_placed(mix(x.astype(np.uint64) + (order << np.uint64(32)) + np.uint64(1)), place).sum(dtype=np.uint64))
    return code - (1 << 64) if code >> 63 else code


@dataclass
class Atoms:
    """The atoms of some texts, in order: their places in the marked texts, and those in their own text."""

    marked: str
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    place: np.ndarray
    hashes: np.ndarray
    single: np.ndarray  # one more than the code point of a character without a piece, else 0

    def string(self, i: int) -> str:
        return self.marked[self.start[i] : self.end[i]]

    def strings(self, which: np.ndarray) -> list[str]:
        return [self.marked[a:b] for a, b in zip(self.start[which].tolist(), self.end[which].tolist(), strict=True)]


class Cutter:
    """Cuts texts into atoms by array operations over their code points."""

    def __init__(self, model: PieceModel) -> None:
        known = sorted(p for p in model.pieces if len(p) == 1)
        self.kind = np.zeros(0x110000, np.int32)
        self.kind[[ord(p) for p in known]] = np.arange(1, len(known) + 1)
        self.n = len(known) + 1
        self.mark = int(self.kind[ord(SPACE)])
        pairs = {p[i : i + 2] for p in model.pieces for i in range(len(p) - 1)}
        together = np.zeros(self.n * self.n, bool)
        together[[int(self.kind[ord(a)]) * self.n + int(self.kind[ord(b)]) for a, b in pairs]] = True
        together[: self.n] = together[:: self.n] = False
        self.together = np.packbits(together, bitorder="little")

    def cut(self, texts: list[str]) -> Atoms:
        """Atoms of texts; an empty text has none."""
        marked = "\n".join([SPACE + t.replace(" ", SPACE) if t else "" for t in texts])
        points = np.frombuffer(marked.encode("utf-32-le"), np.uint32)
        kind = self.kind[points]
        pair = kind[:-1].astype(np.int64) * self.n + kind[1:]
        joined = (self.together[pair >> 3] >> (pair & 7).astype(np.uint8)) & 1
        border = np.concatenate([[True], joined == 0, [True]]) if len(points) else np.zeros(1, bool)
        lengths = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        first = np.cumsum(lengths + 1) - lengths - 1
        breaks = (first + lengths)[:-1]  # between texts
        border[breaks] = True
        border[breaks + 1] = True
        edges = np.flatnonzero(border)
        start, end = edges[:-1], edges[1:]
        own = np.ones(len(points) + 1, bool)
        own[breaks] = False
        keep = own[start]
        start, end = start[keep], end[keep]
        text = np.searchsorted(first + lengths, start, side="right")
        there, back = _powers(max(16, int(len(points)).bit_length()))
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * there[: len(points)], out=total[1:])
        hashes = mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))
        single = np.where((end - start == 1) & (kind[start] == 0), points[start].astype(np.int64) + 1, 0)
        return Atoms(marked, start, end, text, start - first[text], hashes, single)


class Encoder:
    """Atoms by what is known of them here: a bank of ids end to end, for known atoms, single characters, long atoms; -1 is a rare one."""

    def __init__(self, model: PieceModel, known: Known) -> None:
        self.model, self.cutter = model, Cutter(model)
        atoms = known.texts.split("\n") if len(known.sizes) else []
        hashes = _hashes_of(self.cutter, atoms)
        order = np.argsort(hashes)
        self.lookup = Lookup(hashes[order])
        self.of_key = order
        sizes = known.sizes.astype(np.int64)
        self.ids: list[np.ndarray] = [known.ids.astype(np.int64)]
        self.sizes, self.codes, self.exact = sizes, _codes(self.ids[0], sizes, model.chars), known.exact
        self.extra: dict[int | str, int] = {}

    def _add(self, key: int | str, ids: list[int], atom: str) -> int:
        """The number of an entry for a character without a piece (by code point) or a long atom."""
        if key not in self.extra:
            self.extra[key] = len(self.sizes)
            self.ids.append(np.array(ids, np.int64))
            self.sizes = np.append(self.sizes, len(ids))
            self.codes = np.append(self.codes, _codes(self.ids[-1], self.sizes[-1:], self.model.chars))
            self.exact = np.append(self.exact, self.model.decoded(self.ids[-1], self.sizes[-1:])[0].as_py() == atom.replace(SPACE, " ").encode())
        return self.extra[key]

    def number(self, atoms: Atoms) -> np.ndarray:
        """The entry of each atom, -1 for rare ones."""
        out = self.lookup.places(atoms.hashes)
        out[out >= 0] = self.of_key[out[out >= 0]]
        for point in np.unique(atoms.single[atoms.single > 0]).tolist():
            if len(self.extra) > FLUSH:  # a bound on what is remembered; numbers given in this step stay valid
                self.extra.clear()
            out[atoms.single == point] = self._add(point, self.model.direct(chr(point - 1)), chr(point - 1))
        for i in np.flatnonzero(atoms.end - atoms.start > MAX_ATOM).tolist():
            atom = atoms.string(i)
            out[i] = self._add(f"{len(self.sizes)}", self.model.direct(atom), atom)  # not remembered: a key of its own
        return out

    def round_trip(self, texts: list[str], atoms: Atoms, number: np.ndarray) -> np.ndarray:
        """Whether the ids of each text's atoms, but for rare ones, decode to it; U+2581 decodes as a space."""
        told = np.flatnonzero(number >= 0)
        return np.array([SPACE not in t for t in texts], bool) & (np.bincount(atoms.text[told], ~self.exact[number[told]], len(texts)) == 0)

    def trim(self) -> None:
        """Forgets long atoms' entries (and the single characters') when there are many."""
        if len(self.ids) > 4096:
            n = len(self.lookup.keys)
            self.ids, self.sizes, self.codes, self.exact, self.extra = self.ids[:1], self.sizes[:n], self.codes[:n], self.exact[:n], {}


def _hashes_of(cutter: Cutter, atoms: list[str]) -> np.ndarray:
    """Hashes of atoms, as cut() gives them."""
    points = np.frombuffer("".join(atoms).encode("utf-32-le"), np.uint32)
    end = np.cumsum([len(a) for a in atoms], dtype=np.int64)
    start = end - np.array([len(a) for a in atoms], np.int64)
    there, back = _powers(max(16, int(len(points)).bit_length()))
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * there[: len(points)], out=total[1:])
    return mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))


def _halves(code: np.ndarray) -> tuple[pa.Array, pa.Array]:
    return pa.array((code & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array((code >> np.uint64(32)).astype(np.int64))


def piece_digests(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids_code (ids_code() of all ids) and round_trip (whether the ids decode to the text)."""
    spark = docs.sparkSession
    plain = _plain(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    words = dictionary(plain, model, model.table(spark))
    sent = spark.sparkContext.broadcast((model, frequent(words)))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row with the sums of each text, and one for each occurrence of a rare atom."""
        known = Encoder(*sent.value)
        keyed = (pa.RecordBatch.from_arrays([b.select(["row", "doc_id"]).to_struct_array(), b.column("text")], names=["key", "text"]) for b in batches)
        for keys, raw in steps(keyed, STEP):
            texts = [t.decode() for t in raw]
            atoms = known.cutter.cut(texts)
            number = known.number(atoms)
            m = len(texts)
            told = np.flatnonzero(number >= 0)
            n = np.bincount(atoms.text[told], known.sizes[number[told]], m).astype(np.int64)
            exact = known.round_trip(texts, atoms, number)
            code = np.zeros(m, np.uint64)
            if len(told):
                powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(atoms.place.max()), BASE, np.uint64)]), dtype=np.uint64)
                first = np.flatnonzero(np.diff(atoms.text[told], prepend=-1))
                code[atoms.text[told][first]] = np.add.reduceat(known.codes[number[told]] * powers[atoms.place[told]], first)
            known.trim()
            row, rare = np.array([k["row"] for k in keys], np.int64), np.flatnonzero(number < 0)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array([k["doc_id"] for k in keys], pa.int64()), pa.array(n), *_halves(code), pa.array(exact), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64())], names=_PART)
            for i in range(0, len(rare), 20_000):
                part = rare[i : i + 20_000]
                k = len(part)
                yield pa.RecordBatch.from_arrays([pa.array(row[atoms.text[part]]), *(pa.nulls(k, pa.int64()) for _ in range(4)), pa.nulls(k, pa.bool_()), pa.array(atoms.strings(part), pa.string()), pa.array(atoms.place[part])], names=_PART)

    def rare_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            sizes = ids.value_lengths().to_numpy().astype(np.int64)
            code = _placed(_codes(ids.flatten().to_numpy(), sizes, sent.value[0].chars), b.column("at").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.nulls(len(code), pa.int64()), pa.array(sizes), *_halves(code), b.column("exact")], names=_PART[:6])

    parts = written(plain.mapInArrow(split, "row long, doc_id long, n long, low long, high long, exact boolean, atom string, at long"), "parts")
    rare = parts.where("atom IS NOT NULL").select("row", "at", "atom").join(words.select("atom", "ids", "exact"), "atom").select("row", "at", "ids", "exact").mapInArrow(rare_codes, "row long, doc_id long, n long, low long, high long, exact boolean")
    every = parts.where("atom IS NULL").select(*_PART[:6]).unionByName(rare)
    total = every.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n").alias("n_pieces"), F.sum("low").alias("low"), F.sum("high").alias("high"), F.bool_and("exact").alias("round_trip"))
    mask = F.lit(0xFFFFFFFF)
    code = F.shiftleft((F.col("high") + F.shiftright("low", 32)).bitwiseAND(mask), 32).bitwiseOR(F.col("low").bitwiseAND(mask))
    return total.select("doc_id", "n_pieces", code.alias("ids_code"), "round_trip")


_PART = ["row", "doc_id", "n", "low", "high", "exact", "atom", "at"]


def encode(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int> and round_trip (whether the ids decode to the text) of every text."""
    spark = docs.sparkSession
    plain = _plain(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    words = dictionary(plain, model, model.table(spark))
    sent = spark.sparkContext.broadcast((model, frequent(words)))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """ids with -1 in place of every rare atom, and the rare atoms in order."""
        known = Encoder(*sent.value)
        keyed = (pa.RecordBatch.from_arrays([b.select(["row", "doc_id"]).to_struct_array(), b.column("text")], names=["key", "text"]) for b in batches)
        for keys, raw in steps(keyed, STEP):
            texts = [t.decode() for t in raw]
            atoms = known.cutter.cut(texts)
            number = known.number(atoms)
            exact = known.round_trip(texts, atoms, number)
            # the bank of ids, with one -1 at its end for rare atoms
            bank = np.concatenate([*known.ids, [-1]])
            sizes, starts = np.append(known.sizes, 1), np.append(np.cumsum(known.sizes) - known.sizes, len(bank) - 1)
            size, start = sizes[number], starts[number]
            flat = bank[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)].astype(np.int32)
            ends = np.cumsum(np.bincount(atoms.text, size, len(keys)).astype(np.int64))
            rare = np.flatnonzero(number < 0)
            strings, cuts = atoms.strings(rare), np.searchsorted(atoms.text[rare], np.arange(len(keys) + 1))
            known.trim()
            yield pa.RecordBatch.from_arrays([pa.array([k["row"] for k in keys], pa.int64()), pa.array([k["doc_id"] for k in keys], pa.int64()), pa.array([flat[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)], pa.binary()), pa.array([strings[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.list_(pa.string())), pa.array(exact)], names=["row", "doc_id", "code", "rare", "exact"])

    parts = written(plain.mapInArrow(split, "row long, doc_id long, code binary, rare array<string>, exact boolean"), "parts")
    found = parts.select("row", F.posexplode("rare").alias("k", "atom")).join(words.select("atom", "ids", F.col("exact").alias("decodes")), "atom").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("found"), F.bool_and("decodes").alias("decodes"))

    def splice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ids of rare atoms, which come in the order of their places, put in for the -1."""
        for i, b in enumerate(batches):
            code = b.column("code").to_pylist()
            known = np.frombuffer(b"".join(code), np.int32)
            rare = known == -1
            lists = b.column("found").flatten().field("ids")
            size = np.ones(len(known), np.int64)
            size[rare] = lists.value_lengths().to_numpy(zero_copy_only=False)
            ids = np.repeat(known, size)
            ids[np.repeat(rare, size)] = lists.flatten().to_numpy(zero_copy_only=False)
            before = np.concatenate([[0], np.cumsum(size)])
            cuts = before[np.concatenate([[0], np.cumsum([len(c) // 4 for c in code])]).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32())), b.column("round_trip")], names=["doc_id", "ids", "round_trip"])
            if i % 8 == 7:
                trim()
        trim()

    whole = parts.select("row", "doc_id", "code", "exact").join(found, "row", "left")
    return whole.select("doc_id", "code", "found", (F.col("exact") & F.coalesce("decodes", F.lit(True))).alias("round_trip")).mapInArrow(splice, "doc_id long, ids array<int>, round_trip boolean")
