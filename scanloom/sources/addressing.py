"""Scan-set addresses: `dir[ranges]`.

A range is `min[:max][clusterSIZE][:stepN]`; ranges are joined with `+` and nested with brackets; `merged` or `[]` makes
one scan of all. The result is a list of clusters of scan numbers.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_RANGE = re.compile(r"(\d+)(?::(\d+))?(?:cluster(\d+))?(?::step(\d+))?$")


@dataclass(frozen=True)
class Address:
    directory: str
    clusters: tuple[tuple[int, ...], ...] | None  # None: all scans that are there, one by one
    merged: bool = False


def _split(text: str, at: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for c in text:
        depth += (c == "[") - (c == "]")
        if c == at and not depth:
            out.append(cur)
            cur = ""
        else:
            cur += c
    return [*out, cur]


def ranges(text: str) -> tuple[tuple[int, ...], ...]:
    out: list[tuple[int, ...]] = []
    for part in filter(None, (x.strip() for x in _split(text, "+"))):
        if part.startswith("["):
            if not part.endswith("]"):
                raise ValueError(f"unbalanced brackets: {part}")
            out.append(tuple(k for cluster in ranges(part[1:-1]) for k in cluster))
            continue
        m = _RANGE.fullmatch(part)
        if not m:
            raise ValueError(f"not a range of scans: {part}")
        lo, hi, size, step = (int(x) if x else None for x in m.groups())
        numbers = list(range(lo, (lo if hi is None else hi) + 1, step or 1))
        out += [tuple(numbers[k : k + (size or 1)]) for k in range(0, len(numbers), size or 1)]
    return tuple(out)


def parse(text: str) -> Address:
    m = re.fullmatch(r"([^\[\]]*)(?:\[(.*)\])?", text.strip(), re.S)
    if not m:
        raise ValueError(f"not an address: {text}")
    directory, inner = m.groups()
    if inner is None:
        return Address(directory, None)
    if inner in ("", "merged"):
        return Address(directory, None, merged=True)
    return Address(directory, ranges(inner))


def identifier(cluster: tuple[int, ...]) -> str:
    """"003" for a scan, "000:005" for a merged run."""
    return f"{cluster[0]:03d}" if len(cluster) == 1 else f"{cluster[0]:03d}:{cluster[-1]:03d}"
