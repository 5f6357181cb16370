"""Bounded payloads for agents: what a response may hold, and paths of changed fields. Driver-side, on single documents."""

from __future__ import annotations

import json

CEILING = 1_000_000
#: Budgets tried in turn when a payload is too large (fixed values).
BUDGETS = (991_808, 750_000, 500_000)
STRING_BYTES = 4096


def cut_bytes(text: str, limit: int) -> str:
    return text.encode()[:limit].decode(errors="ignore")


def encode(value: object, pretty: bool = False) -> str:
    """Compact JSON; indented only if that fits."""
    compact = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    wide = json.dumps(value, ensure_ascii=False, indent=2) if pretty else compact
    return wide if len(wide.encode()) <= CEILING else compact


def compact(value: object, budget: int) -> tuple[object, int]:
    """The value within a budget of bytes, strings cut and list items left out whole from the end, and what was left out."""
    omitted = 0

    def walk(v: object, left: int) -> tuple[object, int]:
        nonlocal omitted
        if isinstance(v, str):
            v = cut_bytes(v, min(STRING_BYTES, max(0, left - 2)))
            return v, len(encode(v).encode())
        if isinstance(v, list):
            out, used = [], 2
            for i, x in enumerate(v):
                if used >= left or len(encode(x).encode()) > left - used and not isinstance(x, (list, dict, str)):
                    omitted += len(v) - i
                    break
                y, n = walk(x, left - used)
                if used + n > left:
                    omitted += len(v) - i
                    break
                out.append(y)
                used += n + 1
            return out, used
        if isinstance(v, dict):
            out, used = {}, 2
            for k, x in v.items():
                head = len(encode(k).encode()) + 2
                y, n = walk(x, left - used - head)
                if used + head + n > left:
                    omitted += 1
                    continue
                out[k] = y
                used += head + n
            return out, used
        return v, len(encode(v).encode())

    kept, _ = walk(value, budget)
    return kept, omitted


def limit(payload: dict) -> dict:
    """The payload, or what of it fits, with the number of parts left out."""
    if len(encode(payload).encode()) <= CEILING:
        return payload
    for budget in BUDGETS:
        kept, omitted = compact(payload, budget)
        out = {**kept, "truncated": True, "omitted": omitted}
        if len(encode(out).encode()) <= CEILING:
            return out
    return {"truncated": True, "omitted": 1, "error": "payload too large"}


def changed_paths(before: object, after: object, most: int = 64, visits: int = 4096) -> tuple[list[str], bool]:
    """JSON pointers of what differs, and whether the work was cut."""
    out: list[str] = []
    left = visits

    def walk(a: object, b: object, at: str) -> None:
        nonlocal left
        left -= 1
        if left < 0 or len(out) >= most:
            return
        if isinstance(a, dict) and isinstance(b, dict):
            for k in sorted({*a, *b}):
                name = f"{at}/{k.replace('~', '~0').replace('/', '~1')}"
                if k in a and k in b:
                    walk(a[k], b[k], name)
                elif len(out) < most:
                    out.append(name)
        elif isinstance(a, list) and isinstance(b, list):
            for i in range(max(len(a), len(b))):
                if i < len(a) and i < len(b):
                    walk(a[i], b[i], f"{at}/{i}")
                elif len(out) < most:
                    out.append(f"{at}/{i}")
        elif a != b or type(a) is not type(b):
            out.append(at or "/")

    walk(before, after, "")
    return out, left < 0 or len(out) >= most


def envelope(query: str, target: str | None, payload: dict, revision: int | None, generated: str, truncated: bool = False) -> dict:
    head = {"query": query, "target": target, "revision": revision, "generatedAt": generated, "truncated": truncated or None}
    return {k: v for k, v in {**head, **payload}.items() if v is not None}
