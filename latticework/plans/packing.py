"""Packing of source spans into a budget of tokens. Ordered by nature; on the driver, over a few hundred candidates."""

from __future__ import annotations

from dataclasses import dataclass

FILES, SPANS, FILE_TOKENS, SPAN_TOKENS, MERGED_LINES = 32, 64, 2000, 1200, 200


@dataclass(frozen=True)
class Candidate:
    file: str
    start: int | None
    end: int | None
    priority: int
    relevance: float


def span_of(c: Candidate, lines: int) -> tuple[int, int]:
    """The exact span, a window of 80 lines from 5 above a line, or the first 200 lines."""
    if c.start and c.end and c.end >= c.start:
        return max(1, c.start), min(lines, c.end)
    if c.start:
        first = max(1, c.start - 5)
        return first, min(lines, first + 79)
    return 1, min(lines, 200)


def merge_spans(spans: list[tuple[int, int]], most: int = MERGED_LINES) -> list[tuple[int, int]]:
    """Touching spans as one unless that would be too long; then the rest follows on its own."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            first = out[-1][0]
            if max(b, out[-1][1]) - first + 1 <= most:
                out[-1] = (first, max(b, out[-1][1]))
                continue
            a = out[-1][1] + 1
            if a > b:
                continue
        out.append((a, b))
    return out


def tokens(text: str) -> int:
    return -(-len(text.encode()) // 4)


def fit(lines: list[str], limit: int) -> int:
    """How many leading lines fit the limit."""
    used = 0
    for i, line in enumerate(lines):
        used += len(line.encode()) + 1
        if -(-used // 4) > limit:
            return i
    return len(lines)


def pack(candidates: list[Candidate], sources: dict[str, list[str]], budget: int) -> tuple[list[tuple[str, int, int, int]], int]:
    """((file, start, end, tokens) of what to read, number of spans left out), greedily by (priority, relevance, file)."""
    by_file: dict[str, list[Candidate]] = {}
    for c in candidates:
        if c.file in sources:
            by_file.setdefault(c.file, []).append(c)
    order = sorted(by_file, key=lambda f: (min(c.priority for c in by_file[f]), -max(c.relevance for c in by_file[f]), f))
    out, left_out = [], sum(len(by_file[f]) for f in order[FILES:])
    for f in order[:FILES]:
        of_file = FILE_TOKENS
        for a, b in merge_spans([span_of(c, len(sources[f])) for c in by_file[f]]):
            room = min(budget, of_file, SPAN_TOKENS)
            n = fit(sources[f][a - 1 : b], room) if len(out) < SPANS else 0
            if not n:
                left_out += 1
                continue
            size = tokens("\n".join(sources[f][a - 1 : a - 1 + n]) + "\n")
            out.append((f, a, a + n - 1, size))
            budget, of_file = budget - size, of_file - size
    return out, left_out
