"""Words of many texts at once: borders and 64-bit hashes by array operations over their bytes.

The hash of a word is a chain of bijections over its bytes, eight at a time; that of a very long word is a digest. (A
polynomial modulo 2^64 would give equal hashes to some words whatever its base, such as those of the Thue-Morse sequence.) Two
hashes with different tags stand for 128 bits where equality of texts is decided by them.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: all but ASCII white space, or only digits, ASCII letters and everything outside ASCII.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: Bytes of the longest words whose hash is chained by array operations; longer ones have a digest.
CHAINED = 128
_BASE = 0x9E3779B97F4A7C15 | 1
_TAGS = np.array([0x6A09E667F3BCC909, 0xBB67AE8584CAA73B], np.uint64)
_ODD = np.array([0xD1342543DE82EF95, 0xAF251AF3B0F025B5], np.uint64)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


@functools.lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    there, back = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    there[0] = back[0] = 1
    return np.cumprod(there, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    data: np.ndarray  # lower-cased bytes of all texts, a blank after each
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray  # number of the text of each word
    first: np.ndarray  # place of the first word of each text, and the number of words

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, tag: int = 0) -> np.ndarray:
        """Hashes of the words; those with another tag are independent."""
        size = self.end - self.start
        out = mix(size.astype(np.uint64) * np.uint64(_BASE) + _TAGS[tag])
        long = np.flatnonzero(size > CHAINED)
        if len(long):
            out[long] = [self._digest(i, tag) for i in long.tolist()]
        # eight bytes of a word at a time: words of up to eight bytes have different hashes
        eight = np.ndarray(len(self.data) + 1, "<u8", np.concatenate([self.data, np.zeros(8, np.uint8)]).data, strides=(1,))
        at = np.flatnonzero(size <= CHAINED)
        begin, left = self.start[at], size[at]
        while len(at):
            out[at] = mix((out[at] ^ (eight[begin] & _MASKS[np.minimum(left, 8)])) * _ODD[tag])
            more = left > 8
            at, begin, left = at[more], begin[more] + 8, left[more] - 8
        return out

    def _digest(self, i: int, tag: int) -> int:
        return int.from_bytes(hashlib.blake2b(self.word(i), digest_size=8, key=b"%d" % tag).digest(), "little")

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def words_of(texts: list[bytes], alphabet: np.ndarray = NOT_BLANK) -> Words:
    data = _LOWER[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    inside = alphabet[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False)) if len(data) else np.zeros(0, np.int64)
    start, end = edges[::2], edges[1::2]
    stops = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.searchsorted(start, stops)]).astype(np.int64)
    return Words(data, start, end, np.repeat(np.arange(len(texts)), np.diff(first)), first)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of so many consecutive words, over all words (the last ones have none)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = mix(out ^ hashes[j : j + n]) if j else hashes[:n] * np.uint64(_BASE)
    return out


class Lookup:
    """Places of hashes in a sorted table, -1 for others; most others are told by a bit table alone."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(keys >> np.uint64(44)).astype(np.int64)] = True

    def places(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(hashes.shape, -1, np.int64)
        if not len(self.keys):
            return out
        at = self.bits[(hashes >> np.uint64(44)).astype(np.int64)]
        near = hashes[at]
        if len(near):
            k = np.minimum(np.searchsorted(self.keys, near), len(self.keys) - 1)
            out[at] = np.where(self.keys[k] == near, k, -1)
        return out
