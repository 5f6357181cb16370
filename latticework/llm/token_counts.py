"""Token counts by a compiled finite-state transducer.

A byte-level BPE vocabulary is compiled to two deterministic machines:

* the *splitter*, over classes of code points, whose transitions emit the borders of pre-tokens. A chunk of text is a map
  from start states to end states; the maps of all chunks of a batch compose in a parallel prefix scan, after which every
  chunk knows its true start state and emits its borders independently of the others;
* the *counter*, over the bytes of a pre-token, whose transitions carry the change of the number of emitted tokens. Its
  states hold, for each vocabulary prefix that is still open, the token that ends before it and the count there; a token
  may follow another exactly if merging could not have crossed their border. States are built when first reached. Every
  border leads back to its first state, so the map of a pre-token is one number, which is remembered by its text; a long
  pre-token is cut into chunks, whose maps (state to state and added tokens) are remembered and compose.

Defined results: a null or empty text has 0 tokens; the special string of the vocabulary counts as one token wherever it
stands; repeated ids give repeated rows; other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from latticework.llm.common import record_batch, steps

#: States of the splitter.
BEGIN, LETTERS, DIGITS, OTHERS, SPACE, BLANK, QUOTE, WANT_E, WANT_L, SUFFIX = range(10)
N_STATES = 10
#: Classes of code points; the last ten are ASCII characters of the suffixes 's 't 'm 'd 're 've 'll, and the end of a text.
C_OTHER, C_LETTER, C_DIGIT, C_BLANK, C_SPACE, C_QUOTE, C_ONE, C_R, C_V, C_E, C_L, C_END = range(12)
#: What a transition emits: a border before the character, or before the one before it.
BEFORE, BEFORE_LAST = 1, 2
CHUNK = 512
#: Bounds of what a worker remembers; beyond them it starts anew, with the same results.
MAX_STATES, MAX_WORDS, MAX_MAPS, MAX_FOLLOWS = 200_000, 400_000, 10_000, 500_000
#: Characters of the longest pre-token whose count is remembered.
REMEMBERED = 256


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point, as the installed library's pattern engine knows letters, numbers and white space.

    (Python's own tables are of another version of Unicode.) Made once, on the driver. The planes from the fourth on have none
    of these, but marks, tags and private characters.
    """
    from tokenizers import Regex, pre_tokenizers

    points = np.array([c for c in range(1, 0x40000) if not 0xD800 <= c < 0xE000])
    every = points.astype("<u4").tobytes().decode("utf-32-le")
    kind = np.zeros(0x110000, np.uint8)
    for pattern, c in ((r"\p{L}+", C_LETTER), (r"\p{N}+", C_DIGIT), (r"\s+", C_BLANK)):
        for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every):
            kind[points[a:b]] = c
    kind[0x20] = C_SPACE
    for chars, c in (("'", C_QUOTE), ("stmd", C_ONE), ("r", C_R), ("v", C_V), ("e", C_E), ("l", C_L)):
        for x in chars:
            kind[ord(x)] = c
    return kind


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emitted borders for each (state, class)."""
    to, out = np.zeros((N_STATES, 12), np.uint8), np.zeros((N_STATES, 12), np.uint8)
    letters = {C_LETTER, C_ONE, C_R, C_V, C_E, C_L}

    def fresh(c: int) -> int:
        return LETTERS if c in letters else {C_OTHER: OTHERS, C_DIGIT: DIGITS, C_BLANK: BLANK, C_SPACE: SPACE, C_QUOTE: QUOTE}[c]

    def step(q: int, c: int) -> tuple[int, int]:
        if c == C_END:
            return BEGIN, BEFORE_LAST if q in (WANT_E, WANT_L) else 0
        blank = c in (C_BLANK, C_SPACE)
        if q in (SPACE, BLANK):
            if blank:
                return fresh(c), 0
            if q == SPACE:  # the last space belongs to what follows, and a quote after it starts no suffix
                return (OTHERS if c == C_QUOTE else fresh(c)), BEFORE_LAST
            return fresh(c), BEFORE_LAST | BEFORE
        if q == LETTERS and c in letters or q == DIGITS and c == C_DIGIT:
            return q, 0
        if q == OTHERS and c in (C_OTHER, C_QUOTE):
            return q, 0
        if q == QUOTE:
            if c == C_ONE:
                return SUFFIX, 0
            if c in (C_R, C_V):
                return WANT_E, 0
            if c == C_L:
                return WANT_L, 0
            if c in (C_OTHER, C_QUOTE):
                return OTHERS, 0
        if q in (WANT_E, WANT_L):
            if c == (C_E if q == WANT_E else C_L):
                return SUFFIX, 0
            if c in letters:  # no suffix: the letter after the quote began a word
                return LETTERS, BEFORE_LAST
            return fresh(c), BEFORE_LAST | BEFORE
        return fresh(c), BEFORE

    for q in range(N_STATES):
        for c in range(12):
            to[q, c], out[q, c] = step(q, c)
    return to, out


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps (a row each), by doubling."""
    maps, span = maps.copy(), 1
    while span < len(maps):
        maps[span:] = np.take_along_axis(maps[span:], maps[:-span].astype(np.intp), 1)
        span *= 2
    return maps


class Splitter:
    def __init__(self, kind: np.ndarray) -> None:
        self.kind = kind
        self.to, self.out = _splitter()

    def borders(self, kinds: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """Whether a pre-token starts at each position of the classes of texts, each closed by C_END."""
        n = len(kinds)
        rows = -(-n // chunk)
        grid = np.full(rows * chunk, C_END, np.uint8)
        grid[:n] = kinds
        grid = np.ascontiguousarray(grid.reshape(rows, chunk).T)
        flat, out = self.to.ravel(), self.out.ravel()
        maps = np.repeat(np.arange(N_STATES, dtype=np.uint8)[None], rows, 0)
        for column in grid:
            maps = flat[maps * np.uint8(12) + column[:, None]]
        ends = compose_scan(maps)
        state = np.concatenate([[BEGIN], ends[:-1, BEGIN]]).astype(np.uint8)
        emitted = np.zeros((chunk, rows), np.uint8)
        for j, column in enumerate(grid):
            at = state * np.uint8(12) + column
            emitted[j] = out[at]
            state = flat[at]
        emitted = emitted.T.ravel()
        found = (emitted & BEFORE) > 0
        found[:-1] |= (emitted[1:] & BEFORE_LAST) > 0
        return found[:n]


class Counter:
    """The counting transducer of a byte-level BPE vocabulary."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> None:
        tokens = {b: i for i, b in enumerate(dict.fromkeys([*(bytes([x]) for x in range(256)), *(a + b for a, b in merges)]))}
        assert tokens.keys() == vocab.keys()
        self.tokens = tokens  # numbered by age: single bytes, then merges in their order
        self.merged = {}
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(len(tokens))]
        for a, b in merges:
            pair, whole = (tokens[a], tokens[b]), tokens[a + b]
            self.merged[pair] = whole
            self.parts[whole] = pair
        self.children: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for token, i in tokens.items():
            node = 0
            for x in token:
                if x not in self.children[node]:
                    self.children[node][x] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                node = self.children[node][x]
            self.ends[node] = i
        self.reset()

    def reset(self) -> None:
        start = ((0, -1, 0),)
        self.follows: dict[int, bool] = {}
        #: State maps of chunks of long pre-tokens, as far as they are known: the state after it, and the tokens that it adds.
        self.maps: dict[bytes, dict[int, tuple[int, int]]] = {}
        self.states = {start: 0}
        self.opened = [start]
        self.arcs: list[dict[int, tuple[int, int]]] = [{}]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether no merge of the two tokens' parts across their border precedes the merges that made them."""
        if left < 0:
            return True
        key = left << 32 | right
        known = self.follows.get(key)
        if known is None:
            a, b, newest = left, right, len(self.parts)
            known = True
            while True:
                if self.merged.get((a, b), newest) < newest:
                    known = False
                    break
                if a == self.parts[a][1] and b == self.parts[b][0]:
                    break
                # undo the younger of the two; at the same age the left one merged first
                if a > b and a != self.parts[a][1]:
                    newest, a = a, self.parts[a][1]
                elif b != self.parts[b][0]:
                    newest, b = b + 1, self.parts[b][0]
                else:
                    newest, a = a, self.parts[a][1]
            if len(self.follows) > MAX_FOLLOWS:
                self.follows.clear()
            self.follows[key] = known
        return known

    def arc(self, state: int, byte: int) -> tuple[int, int]:
        """Builds a transition: the state it leads to, and by how much the number of tokens changes."""
        opened, last, count = [], -1, 0
        for node, before, there in self.opened[state]:
            child = self.children[node].get(byte)
            if child is not None:
                if self.ends[child] >= 0 and self.may_follow(before, self.ends[child]):
                    last, count = self.ends[child], there + 1
                if self.children[child]:
                    opened.append((child, before, there))
        key = (*((node, before, there - count) for node, before, there in opened), (0, last, 0))
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.opened)
            self.opened.append(key)
            self.arcs.append({})
        made = self.arcs[state][byte] = (to, count)
        return made

    def run(self, state: int, word: bytes) -> tuple[int, int]:
        """The state after some bytes, and the tokens that they add."""
        total, arcs = 0, self.arcs
        for byte in word:
            found = arcs[state].get(byte)
            state, change = found if found is not None else self.arc(state, byte)
            total += change
        return state, total

    def count(self, word: bytes) -> int:
        if len(self.opened) > MAX_STATES or len(self.maps) > MAX_MAPS:
            self.reset()
        if len(word) <= CHUNK:
            return self.run(0, word)[1]
        # a long pre-token's chunks: the map of each is extended to the state that it is met in, and the maps compose
        state = total = 0
        for i in range(0, len(word), CHUNK):
            chunk = word[i : i + CHUNK]
            known = self.maps.setdefault(chunk, {})
            if state not in known:
                known[state] = self.run(state, chunk)
            state, change = known[state]
            total += change
        return total


def load(path: str) -> tuple[Counter, list[str]]:
    """The transducer of a tokenizer file, and its special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    raw = lambda s: bytes(back[c] for c in s)
    merges = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in spec["model"]["merges"]]
    special = [t["content"] for t in spec["added_tokens"]]
    return Counter({raw(k): v for k, v in spec["model"]["vocab"].items() if k not in special}, merges), special


class Words(dict):
    """Token counts of pre-tokens, from the transducer."""

    def __init__(self, counter: Counter) -> None:
        self.counter = counter

    def __missing__(self, word: str) -> int:
        n = self.counter.count(word.encode())
        if len(word) <= REMEMBERED:
            if len(self) > MAX_WORDS:
                self.clear()
            self[word] = n
        return n


class TokenCounter:
    def __init__(self, path: str, kind: np.ndarray) -> None:
        counter, self.special = load(path)
        self.words, self.splitter = Words(counter), Splitter(kind)

    def counts(self, texts: list[str]) -> list[int]:
        """Number of tokens of each text."""
        totals, parts, owner = [0] * len(texts), [], []
        for i, text in enumerate(texts):
            pieces = [text]
            for s in self.special:
                if s in text:
                    cut = [p.split(s) for p in pieces]
                    totals[i] += sum(len(c) - 1 for c in cut)
                    pieces = [p for c in cut for p in c]
            parts += pieces
            owner += [i] * len(pieces)
        if not parts:
            return totals
        lengths = np.array([len(p) for p in parts])
        ends = np.cumsum(lengths + 1) - 1
        points = np.frombuffer("\0".join([*parts, ""]).encode("utf-32-le"), np.uint32)
        kinds = self.splitter.kind[points]
        kinds[ends] = C_END
        at = np.flatnonzero(self.splitter.borders(kinds))
        first = np.searchsorted(at, ends - lengths).tolist()
        at = at.tolist()
        first.append(len(at))
        count = self.words.__getitem__
        for k, part in enumerate(parts):
            if part:
                base = int(ends[k] - lengths[k])
                cuts = [x - base for x in at[first[k] : first[k + 1]]]
                totals[owner[k]] += sum(map(count, [part[a:b] for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True)]))
        return totals


_TYPES = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_tokens": pa.int64()}
_loaded: dict[str, TokenCounter] = {}


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and n_tokens of every text; one pass without a shuffle, in memory bounded by one text or step."""

    kind = docs.sparkSession.sparkContext.broadcast(classes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _loaded:
            _loaded[tokenizer_path] = TokenCounter(tokenizer_path, kind.value)
        counter = _loaded[tokenizer_path]
        for ids, texts in steps(batches):
            yield record_batch({"doc_id": ids, "n_bytes": [len(t) for t in texts], "n_tokens": counter.counts([t.decode() for t in texts])}, _TYPES)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
