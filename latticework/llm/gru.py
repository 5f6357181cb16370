"""A gated recurrent language model in numpy.

Documents lie end to end in lanes, every one after the end token of the one before it, and the end token resets the state;
the state is carried across windows, so the log-likelihood of a document is that of its complete text. The output softmax is
factored: the class of the next word, then the word within its class. Training backpropagates through a window.
"""

from __future__ import annotations

import numpy as np

END = 0
HIDDEN, LANES, WINDOW = 24, 384, 16


def classes_of(counts: np.ndarray, n_classes: int) -> np.ndarray:
    """Class of each word, by equal shares of the sum of root counts; counts descend, the end and the unknown word lead."""
    root = np.sqrt(np.maximum(counts, 1e-9))
    root[:2] = 0
    at = np.cumsum(root) - root / 2
    cls = 2 + np.minimum((at / max(at[-1] if len(at) else 1, 1e-9) * (n_classes - 2)).astype(np.int64), n_classes - 3)
    cls[: min(2, len(cls))] = np.arange(min(2, len(cls)))
    # numbered without gaps, in order
    return np.unique(cls, return_inverse=True)[1]


class Gru:
    """Parameters: input table e (word, 3 gates), recurrent u, class output wc, word output wo, and biases."""

    def __init__(self, counts: np.ndarray, n_classes: int, hidden: int = HIDDEN, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        n = len(counts)
        self.cls = classes_of(counts.astype(float), n_classes)
        self.size = np.bincount(self.cls)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        share = (counts + 0.5) / (counts.sum() + 0.5 * n)
        by_class = np.bincount(self.cls, weights=share)
        f = np.float32
        self.p = {
            "e": rng.normal(0, 0.1, (n, 3 * hidden)).astype(f),
            "u": rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(f),
            "b": np.concatenate([np.full(hidden, 1.0), np.zeros(2 * hidden)]).astype(f),
            "wc": np.zeros((hidden, len(self.size)), f),
            "bc": np.log(by_class).astype(f),
            "wo": rng.normal(0, 0.02, (n, hidden)).astype(f),
            "bo": np.log(share / by_class[self.cls]).astype(f),
        }

    # the recurrence ---------------------------------------------------------------------------------------------------

    def run(self, x: np.ndarray, h: np.ndarray, keep: bool) -> tuple[np.ndarray, tuple]:
        """States after each input of a window (time, lane), and what backpropagation needs."""
        k = h.shape[1]
        # the three gates lie apart, so that operations run over whole arrays
        u = self._apart(self.p["u"])
        table = self.table if hasattr(self, "table") else self._apart(self.p["e"] + self.p["b"])
        inputs = np.take(table, x, axis=1)
        ends = [np.flatnonzero(row == END) for row in x]
        shape = (len(x), len(h), k) if keep else (1, len(h), k)
        # a row for each time where backpropagation follows, else one that is written over
        before, candidate, gates, inner = np.empty(shape, np.float32), np.empty(shape, np.float32), np.empty((2, *shape), np.float32), np.empty((3, *shape), np.float32)
        out = np.empty((len(x), len(h), k), np.float32)
        for t in range(len(x)):
            i = t if keep else 0
            a, b, n, g = inputs[:, t], before[i], candidate[i], inner[:, i]
            np.copyto(b, h)
            b[ends[t]] = 0
            np.matmul(b, u, out=g)
            gate = np.add(a[:2], g[:2], out=gates[:, i])
            np.negative(gate, out=gate)
            np.exp(gate, out=gate)
            gate += 1
            np.reciprocal(gate, out=gate)
            np.multiply(gate[1], g[2], out=n)
            n += a[2]
            np.tanh(n, out=n)
            new = np.subtract(b, n, out=out[t])
            new *= gate[0]
            new += n
            h = new
        return out, (x, before, gates, candidate, inner[2])

    @staticmethod
    def _apart(v: np.ndarray) -> np.ndarray:
        """(gate, row, unit) of (row, gate and unit)."""
        return np.ascontiguousarray(v.reshape(len(v), 3, -1).transpose(1, 0, 2))

    # the output -------------------------------------------------------------------------------------------------------

    def log_prob(self, hs: np.ndarray, y: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of each next word; with grad, adds the output gradients and returns that of the states."""
        # rows in the order of their class, so that each class is a slice
        cls = self.cls[y]
        order = np.argsort(cls.astype(np.uint8 if len(self.size) < 256 else np.int32), kind="stable")
        hs, cls = hs[order], cls[order]
        place = y[order] - self.start[cls]
        logits = hs @ self.p["wc"]
        logits += self.p["bc"]
        at = np.arange(len(y))
        chosen = logits[at, cls]
        np.exp(logits, out=logits)
        one = np.ones(max(len(y), len(self.cls)), np.float32)  # sums are products with it
        total = logits @ one[: logits.shape[1]]
        ordered = chosen - np.log(total)
        dh = None
        if grad is not None:
            logits /= total[:, None]
            logits[at, cls] -= 1
            grad["wc"] += hs.T @ logits
            grad["bc"] += one[: len(y)] @ logits
            dh = logits @ self.p["wc"].T
        sums = np.ones_like(ordered)
        cuts = np.searchsorted(cls, np.arange(len(self.size) + 1))
        for c in np.flatnonzero((np.diff(cuts) > 0) & (self.size > 1)).tolist():
            i = slice(cuts[c], cuts[c + 1])
            a, b = self.start[c], self.start[c + 1]
            w, h = self.p["wo"][a:b], hs[i]
            inner = h @ w.T
            inner += self.p["bo"][a:b]
            row, k = at[: len(h)], place[i]
            mine = inner[row, k]
            np.exp(inner, out=inner)
            s = inner @ one[: b - a]
            ordered[i] += mine
            sums[i] = s
            if grad is not None:
                inner /= s[:, None]
                inner[row, k] -= 1
                grad["wo"][a:b] += inner.T @ h
                grad["bo"][a:b] += one[: len(h)] @ inner
                dh[i] += inner @ w
        ordered -= np.log(sums)
        lp = np.empty_like(ordered)
        lp[order] = ordered
        if dh is not None:
            dh[order] = dh.copy()
        return lp, dh

    # learning ---------------------------------------------------------------------------------------------------------

    def backward(self, saved: tuple, dhs: np.ndarray, grad: dict) -> tuple[np.ndarray, np.ndarray]:
        """Adds the gradients of a window; returns the words whose rows of e have any, and these rows."""
        k = dhs.shape[2]
        back = np.ascontiguousarray(self._apart(self.p["u"]).transpose(0, 2, 1))
        x, h, (z, r), n, gn = saved
        ends = [np.flatnonzero(row == END) for row in x]
        # what the gradient of a state is multiplied by, for each gate, over the whole window
        by = np.empty((3, *dhs.shape), np.float32)
        update, reset, new = by
        rest = 1 - z
        np.multiply(n, n, out=new)
        np.subtract(1, new, out=new)
        new *= rest
        np.subtract(h, n, out=update)
        update *= z
        update *= rest
        np.subtract(1, r, out=reset)
        reset *= r
        reset *= gn
        reset *= new
        da, dn = np.empty_like(by), np.empty_like(dhs)
        carried = np.zeros_like(dhs[0])
        for t in reversed(range(len(x))):
            d = dhs[t] + carried
            np.multiply(by[:, t], d, out=da[:, t])
            np.multiply(da[2, t], r[t], out=dn[t])
            d *= z[t]
            d += da[0, t] @ back[0]
            d += da[1, t] @ back[1]
            d += dn[t] @ back[2]
            d[ends[t]] = 0
            carried = d
        da, across = da.reshape(3, -1, k), h.reshape(-1, k).T
        grad["u"] += np.concatenate([across @ da[0], across @ da[1], across @ dn.reshape(-1, k)], axis=1)
        grad["b"] += (np.ones(da.shape[1], np.float32) @ da).ravel()
        da = np.ascontiguousarray(da.transpose(1, 0, 2)).reshape(-1, 3 * k)
        w = x.ravel()
        order = np.argsort(w.astype(np.uint16) if len(self.cls) <= 1 << 16 else w, kind="stable")
        w = w[order]
        first = np.flatnonzero(np.diff(w, prepend=-1))
        return w[first], np.add.reduceat(da[order], first, axis=0)

    def train(self, lanes: np.ndarray, rate: float = 0.1, window: int = WINDOW) -> int:
        """One pass over lanes (time, lane) of words, -1 where a lane is over; returns the words learned from.

        The state runs through all windows, and every window is learned from, by Adagrad.
        """
        h = np.zeros((lanes.shape[1], self.p["u"].shape[0]), np.float32)
        if not hasattr(self, "squares"):
            self.squares = {name: np.full_like(v, 0.1) for name, v in self.p.items()}
        seen, full = 0, 4 * np.sqrt(lanes.shape[1] * window)
        x_all = np.concatenate([np.full((1, lanes.shape[1]), END), lanes[:-1]])
        for t in range(0, len(lanes), window):
            y = lanes[t : t + window]
            live = int((y[0] >= 0).sum())  # lanes are in order of length
            if not live:
                break
            x, y, h = np.maximum(x_all[t : t + window, :live], 0), y[:, :live], h[:live]
            hs, saved = self.run(x, h, True)
            h = hs[-1]
            grad = {name: np.zeros_like(v) for name, v in self.p.items() if name != "e"}
            flat, ok = np.maximum(y, 0).ravel(), (y >= 0).ravel()
            _, dh = self.log_prob(hs.reshape(-1, hs.shape[2])[ok], flat[ok], grad)
            dhs = np.zeros((len(flat), hs.shape[2]), np.float32)
            dhs[ok] = dh
            used, grad["e"] = self.backward(saved, dhs.reshape(hs.shape), grad)
            n = int(ok.sum())
            seen += n
            for name, g in grad.items():
                # rows of e without a gradient stay as they are
                rows = used if name == "e" else slice(None)
                g /= full  # the same for all windows, so that a few long lanes at the end weigh little
                np.clip(g, -1, 1, out=g)
                squares = self.squares[name][rows] + g * g
                self.squares[name][rows] = squares
                np.sqrt(squares, out=squares)
                g *= rate
                g /= squares
                self.p[name][rows] -= g
        return seen

    def score(self, lanes: np.ndarray, window: int = 64) -> np.ndarray:
        """log10 probability of each word of the lanes, 0 where a lane is over."""
        self.table = self._apart(self.p["e"] + self.p["b"])
        h = np.zeros((lanes.shape[1], self.p["u"].shape[0]), np.float32)
        out = np.zeros(lanes.shape, np.float32)
        x_all = np.concatenate([np.full((1, lanes.shape[1]), END), lanes[:-1]])
        for t in range(0, len(lanes), window):
            y = lanes[t : t + window]
            live = int((y[0] >= 0).sum())
            if not live:
                break
            y = y[:, :live]
            hs, _ = self.run(np.maximum(x_all[t : t + window, :live], 0), h[:live], False)
            h = hs[-1]
            ok = y.ravel() >= 0
            lp = np.zeros(y.size, np.float32)
            lp[ok] = self.log_prob(hs.reshape(-1, hs.shape[2])[ok], y.ravel()[ok])[0]
            out[t : t + window, :live] = lp.reshape(y.shape)
        del self.table
        return out / np.float32(np.log(10))


def pack(lengths: np.ndarray, lanes: int = LANES) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Lane and first time of each document (longest first, onto the lane that is least full); lanes by falling length."""
    import heapq

    lanes = int(max(1, min(lanes, len(lengths), lengths.sum() // 64 + 1)))
    heap = [(0, i) for i in range(lanes)]
    lane, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for d in np.argsort(-lengths, kind="stable").tolist():
        used, i = heapq.heappop(heap)
        lane[d], at[d] = i, used
        heapq.heappush(heap, (used + int(lengths[d]), i))
    used = np.zeros(lanes, np.int64)
    np.add.at(used, lane, lengths)
    rank = np.empty(lanes, np.int64)
    rank[np.argsort(-used, kind="stable")] = np.arange(lanes)
    return rank[lane], at, lanes, int(used.max()) if lanes else 0


def laid_out(words: np.ndarray, lengths: np.ndarray, lanes: int = LANES) -> tuple[np.ndarray, np.ndarray]:
    """(time, lane) of documents' words that lie end to end, -1 elsewhere; and each word's place in it, flattened."""
    lane, at, n, height = pack(lengths, lanes)
    first = np.cumsum(lengths) - lengths
    place = (np.arange(len(words)) - np.repeat(first - at, lengths)) * n
    place += np.repeat(lane, lengths)
    grid = np.full(height * n, -1, np.int32)
    grid[place] = words
    return grid.reshape(height, n), place


def stream(words: np.ndarray, lanes: int) -> np.ndarray:
    """(time, lane) of one stream of words cut in equal lanes, for learning; -1 after its end."""
    lanes = int(max(1, min(lanes, len(words) // 1024)))
    height = -(-len(words) // lanes)
    grid = np.full(height * lanes, -1, np.int32)
    grid[: len(words)] = words
    return np.ascontiguousarray(grid.reshape(lanes, height).T)
