"""MinHash near-duplicates of documents, by SuperMinHash signatures.

1. Every text becomes its set of word shingles, each known by two independent 64-bit hashes of its words. Texts whose sets
   are equal in both are one class, whose smallest id stands for it.
2. Signatures: each shingle visits the signature's slots in an order of its own, with a value that grows by one a visit;
   a slot keeps the least. All texts of a step are advanced visit by visit, and a text stops as soon as no later visit can
   lower a slot, which for all but short texts is after two or three. Bands of slots are the keys of candidates.
3. Classes that share a band key and whose sketches (two bits of each slot) are not far below the threshold are joined to
   clusters. A large bucket is dealt out in blocks; every pair of blocks is compared in its own task, which returns no more
   links than it has rows.
4. The texts of clusters are taken out of all texts once. Clusters are verified on full sets of both hashes, and the
   confirmed links give the components. A cluster of one block is compared whole. In a larger one each class is first
   compared with one other, which settles it if those links make it one component; what is left is compared by pairs of blocks.

A pair at the threshold shares no band with probability 5e-6 or less; later steps lose none.

Defined results: texts that are null, empty or without words have an empty set and are linked with nothing; a text with
fewer words than a shingle has its whole word sequence as one shingle; repeated rows are one class; rows without an id are
linked with nothing, and have no component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import record_batch, steps, written
from latticework.llm.components import HUBS, LEAST_HUB, components, spanning
from latticework.llm.words import mix, words_of

SHINGLE, PERCENT = 5, 75
SLOTS, ROWS = 128, 4
#: Of 128 two-bit slots of two sketches, so many agree at a similarity of 0.4 on average; at 0.75, less than 1e-12 have fewer.
SKETCH_AGREE = 70
#: Members of a block when sketches and when sets are compared, and bytes of its sets.
BLOCK, SET_BLOCK, SET_BYTES = 256, 256, 8 << 20
#: Ids of clusters' members that are sent to all tasks at most.
SENT = 1 << 20
_C = np.uint64(0x9E3779B97F4A7C15)


def _times(n: int) -> np.uint64:
    return np.uint64(int(_C) * n % 2**64)


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Distinct shingles of each text, as rows of two independent hashes, ascending by the first."""
    words = words_of(texts)
    n = words.counts
    both = []
    for tag in (0, 1):
        h = words.hashes(tag)
        grams = np.zeros(len(h), np.uint64)
        if len(h) >= size:
            part = h[: len(h) - size + 1] * _C
            for j in range(1, size):
                part = mix(part ^ h[j : len(h) - size + 1 + j])
            grams[: len(part)] = part
        # a short text's whole sequence, and its number of words, take the place of its first shingle
        short = np.flatnonzero((n > 0) & (n < size))
        if len(short):
            x = n[short].astype(np.uint64)
            for j in range(size - 1):
                on = n[short] > j
                x[on] = mix(x[on] * _C ^ h[words.first[:-1][short[on]] + j])
            grams[words.first[:-1][short]] = x
        both.append(grams)
    grams = np.stack(both, 1)
    out = []
    for a, k in zip(words.first[:-1].tolist(), n.tolist(), strict=True):
        rows = grams[a : a + (k - size + 1 if k >= size else min(k, 1))]
        _, first = np.unique(rows[:, 0], return_index=True)
        out.append(rows[first])
    return out


def super_min_hash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures of sets of hashes, a row each; those of empty sets are infinite."""
    sizes = np.array([len(s) for s in sets], np.int64)
    least = np.full((len(sets), slots), np.inf)
    flat = least.ravel()
    x = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), sizes)
    visits: list[np.ndarray] = []
    for j in range(slots):
        if not len(x):
            break
        r = mix(x + _times(2 * j + 1))
        k = (j + (mix(x + _times(2 * j + 2)) >> np.uint64(11)).astype(np.float64) * (2.0**-53 * (slots - j))).astype(np.int16)
        k = np.minimum(k, slots - 1)
        slot = k.copy()  # where the j-th visit leads: what the earlier exchanges of the shuffle left at place k
        for i in range(j - 1, -1, -1):
            slot[visits[i] == slot] = i
        np.minimum.at(flat, doc * slots + slot, (r >> np.uint64(11)).astype(np.float64) * 2.0**-53 + j)
        visits.append(k)
        open_docs = least.max(1) >= j + 1
        on = open_docs[doc]
        if not on.all():
            x, doc, visits = x[on], doc[on], [v[on] for v in visits]
    return least


def band_keys(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bits = mix(signatures.view(np.uint64))
    bands = signatures.shape[1] // rows
    key = np.arange(1, bands + 1, dtype=np.uint64)[None].repeat(len(bits), 0) * _C
    for j in range(rows):
        key = mix(key ^ bits[:, j : bands * rows : rows])
    return key


def sketches(signatures: np.ndarray) -> np.ndarray:
    """Two bits of each slot, 32 slots a number."""
    two = mix(signatures.view(np.uint64) ^ _C) >> np.uint64(62)
    return np.bitwise_or.reduce(two.reshape(len(two), -1, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2)), axis=2)


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal slots of all pairs of sketches."""
    x = a[:, None, :] ^ b[None, :, :]
    x = (x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)
    return 32 * a.shape[1] - np.bitwise_count(x).sum(2, dtype=np.int64)


def linked(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Whether 100 * intersection >= percent * union, for all pairs; elements are equal if both of their hashes are."""
    sizes = np.array([len(s) for s in sets], np.int64)
    n = len(sets)
    keys, member = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    keys, member = keys[order], member[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])
    group = np.cumsum(new) - 1
    shared = np.bincount(group)[group] > 1
    member, group = member[shared], group[shared]
    group = np.unique(group, return_inverse=True)[1] if len(group) else group
    both = np.zeros((n, n), np.float32)
    width = 4096
    edges = np.searchsorted(group, np.arange(0, (int(group[-1]) if len(group) else -1) + width + 1, width))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        block = np.zeros((n, width), np.float32)
        block[member[a:b], group[a:b] % width] = 1
        both += block @ block.T
    common = both.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    return (100 * common >= percent * union) & (common > 0)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether 100 * intersection >= percent * union, for two sets."""
    if not len(a) or not len(b):
        return False
    at = np.minimum(np.searchsorted(a[:, 0], b[:, 0]), len(a) - 1)
    common = int((a[at] == b).all(1).sum())
    return common > 0 and 100 * common >= percent * (len(a) + len(b) - common)


_SIGNED = {"doc_id": pa.int64(), "n": pa.int64(), "f1": pa.int64(), "f2": pa.int64(), "bands": pa.list_(pa.int64()), "sketch": pa.list_(pa.int64())}


def _signatures(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in steps(batches):
            sets = shingle_sets(texts, size)
            sig = super_min_hash([s[:, 0] for s in sets])
            full = [len(s) > 0 for s in sets]
            # 128 bits of a set: from one hash of its elements, and from the other
            f1 = [int(mix(s[:, 0]).sum(dtype=np.uint64)) if len(s) else 0 for s in sets]
            f2 = [int(mix(s[:, 1] ^ _C).sum(dtype=np.uint64)) if len(s) else 0 for s in sets]
            keys, short = band_keys(sig).view(np.int64).tolist(), sketches(sig).view(np.int64).tolist()
            signed = lambda v: [x - (1 << 64) if x >> 63 else x for x in v]
            yield record_batch({"doc_id": ids, "n": [len(s) for s in sets], "f1": signed(f1), "f2": signed(f2), "bands": [k if f else [] for k, f in zip(keys, full, strict=True)], "sketch": [k if f else [] for k, f in zip(short, full, strict=True)]}, _SIGNED)

    return docs.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, bands array<long>, sketch array<long>")


def _block_pairs(df: DataFrame, key: str, member: str, blocks: Column) -> DataFrame:
    """Each row once for every pair of its group's blocks that has its block; small groups are one pair."""
    df = df.withColumn("nb", blocks.cast("long")).withColumn("own", F.pmod(F.xxhash64(member), F.col("nb")))
    return df.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "nb").repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", member)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch | pa.Table]]:
    """Slices of sorted rows with equal leading columns; a group may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        if last is not None and first != last and held:
            yield held
            held = []
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a and held:
                yield held
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in cols)
    if held:
        yield held


def _edge_batches(pairs: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for x, y in pairs:
        a.append(x)
        b.append(y)
        if len(a) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _sketch_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, i, j, own, class, n, sketch): a spanning forest of similar sketches in each group."""

    def pairs() -> Iterator[tuple[int, int]]:
        for group in _groups(batches, 3):
            t = pa.Table.from_batches(group)
            ids = t.column("class").to_numpy()
            if len(ids) < 2:
                continue
            n = t.column("n").to_numpy()
            s = t.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
            near = (agreement(s, s) >= SKETCH_AGREE) & (100 * np.minimum(n[:, None], n[None]) >= PERCENT * np.maximum(n[:, None], n[None]))
            yield from ((int(ids[x]), int(ids[y])) for x, y in spanning(near))

    yield from _edge_batches(pairs())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) and kept (whether it is the document's own)."""
    plain = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    signed = written(_signatures(plain, size), "signatures")
    real = signed.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = written(real.groupBy("f1", "f2", "n").agg(F.min_by(F.struct("bands", "sketch"), "doc_id").alias("s"), F.min("doc_id").alias("class")).select("f1", "f2", "n", "class", "s.bands", "s.sketch"), "classes")
    bands = classes.select(F.explode("bands").alias("band"), "class")
    sizes = bands.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    members = bands.join(sizes, "band").join(classes.select("class", "n", "sketch"), "class")
    dealt = _block_pairs(members, "band", "class", F.ceil(F.col("size") / BLOCK)).select("band", "i", "j", "own", "class", "n", "sketch")
    links = written(dealt.mapInArrow(_sketch_links, "a long, b long").distinct(), "links")
    clusters = written(components(links), "clusters")
    n_nodes = clusters.count()
    # the texts of all clusters, found once: up to SENT ids go to where the texts are, more are met by a shuffle of all texts
    ids = clusters.select(F.col("node").alias("class"))
    held = written(plain.withColumnRenamed("doc_id", "class").join(F.broadcast(ids) if n_nodes <= SENT else ids.hint("merge"), "class", "left_semi"), "texts")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """wanted (class, and other long columns) with the set of each class's text."""
        names = wanted.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keyed = (pa.RecordBatch.from_arrays([b.select(names).to_struct_array(), b.column("text")], names=["key", "text"]) for b in batches)
            for keys, texts in steps(keyed):
                out = {c: [k[c] for k in keys] for c in names} | {"set": [s.tobytes() for s in shingle_sets(texts, size)]}
                yield record_batch(out, {c: pa.int64() for c in names} | {"set": pa.binary()})

        return held.join(wanted, "class").select(*names, "text").mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", set binary")

    def set_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[int, int]]:
            for group in _groups(batches, 3):
                t = pa.Table.from_batches(group)
                ids = t.column("class").to_numpy()
                if len(ids) > 1:
                    sets = [np.frombuffer(x, np.uint64).reshape(-1, 2) for x in t.column("set").to_pylist()]
                    yield from ((int(ids[x]), int(ids[y])) for x, y in spanning(linked(sets, percent)))

        yield from _edge_batches(pairs())

    def star_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (parent, salt, role, class, set), the parent's own (role 0) before the others of its group, which stream past."""

        def pairs() -> Iterator[tuple[int, int]]:
            group, own = None, np.zeros((0, 2), np.uint64)
            for b in batches:
                for parent, salt, role, x, raw in zip(*(b.column(c).to_pylist() for c in ("parent", "salt", "role", "class", "set")), strict=True):
                    rows = np.frombuffer(raw, np.uint64).reshape(-1, 2)
                    if role == 0:
                        group, own = (parent, salt), rows
                    elif group == (parent, salt) and similar(own, rows, percent):
                        yield x, parent

        yield from _edge_batches(pairs())

    weighed = clusters.select(F.col("node").alias("class"), F.col("component").alias("cluster")).join(classes.select("class", "n"), "class")
    load = weighed.groupBy("cluster").agg(F.count_distinct("class").alias("members"), F.greatest(F.ceil(F.count("*") / SET_BLOCK), F.ceil(F.sum("n") * 16 / SET_BYTES)).cast("long").alias("nb"))
    # clusters of more than most members are few, and their rows stay where they are; all others are shuffled
    most = max(LEAST_HUB, n_nodes // HUBS)
    load = written(load, "load")
    heavy = F.broadcast(load.where(F.col("members") > most))
    rest = weighed.join(heavy.select("cluster"), "cluster", "left_anti").join(load.where(F.col("members") <= most), "cluster")
    placed = written(weighed.join(heavy, "cluster").unionByName(rest).select("class", "cluster", "nb", "members"), "placed")
    # In a cluster of several blocks each class is first compared with the least one that it has a link to. If all but one of
    # its classes are confirmed so, the links are a tree, for all lead to smaller ones, and the cluster is one component.
    up = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("class")).agg(F.min("b").alias("parent")).where("parent < class")
    star = up.join(placed.where("nb > 1"), "class").select("class", "parent", F.pmod(F.xxhash64("class"), F.col("nb")).alias("salt")).distinct()
    needs = star.withColumn("role", F.lit(1).cast("long")).unionByName(star.select(F.col("parent").alias("class"), "parent", "salt").distinct().withColumn("role", F.lit(0).cast("long")))
    starred = written(sets_of(needs).repartition("parent", "salt").sortWithinPartitions("parent", "salt", "role").select("parent", "salt", "role", "class", "set").mapInArrow(star_links, "a long, b long").distinct(), "starred")
    trees = starred.select(F.col("a").alias("class")).join(placed.select("class", "cluster", "members").distinct(), "class").groupBy("cluster").agg(F.count("*").alias("edges"), F.first("members").alias("of")).where("edges = of - 1").select("cluster", "of")
    trees = written(trees, "trees")
    of_heavy = placed.where(F.col("members") > most).join(F.broadcast(trees.where(F.col("of") > most)), "cluster", "left_anti")
    wanted = placed.where(F.col("members") <= most).join(trees.where(F.col("of") <= most), "cluster", "left_anti").unionByName(of_heavy).select("class", "cluster", "nb")
    compared = _block_pairs(sets_of(wanted), "cluster", "class", F.col("nb")).select("cluster", "i", "j", "own", "class", "set").mapInArrow(set_links, "a long, b long")
    verified = compared.unionByName(starred)
    found = written(components(verified), "components")
    of_class = classes.select("f1", "f2", "n", "class").join(found.select(F.col("node").alias("class"), "component"), "class", "left").select("f1", "f2", "n", F.coalesce("component", "class").alias("component"))
    out = signed.select("doc_id", "n", "f1", "f2").join(of_class, ["f1", "f2", "n"], "left")
    own = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    result = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))
    return result.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def brute_force(rows: list[tuple[int, str | None]], size: int = SHINGLE, percent: int = PERCENT) -> dict[int, tuple[int, int]]:
    """(n_shingles, component) of each id, by comparing all pairs of sets of word tuples."""
    from latticework.llm.components import UnionFind

    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    uf = UnionFind(len(rows))
    for x, a in enumerate(order):
        for y in range(x):
            b = order[y]
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                uf.join(y, x)
    return {rows[i][0]: (len(sets[i]), rows[order[uf.find(x)]][0]) for x, i in enumerate(order)}

