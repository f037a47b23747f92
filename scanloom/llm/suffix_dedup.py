"""Exact substring deduplication over bytes with suffix arrays built column by column.

Whole texts are cut into overlapping segments, so that every SPAN-byte string of every document is in exactly one
segment, and equal strings are in segments of one bucket at the same offset to an equal anchor, a string of GRAM bytes
(see repeats.py). A bounded sketch drops buckets that occur once.

The classes of a bucket, but for those parts at their ends whose windows have no other of their hash, form a small
collection of strings, whose Burrows-Wheeler transform and longest common
prefixes are built the column-wise way: each round takes one symbol of every string, from the last to the first, writes
it into the transform at the place of the string's latest suffix, finds where the longer suffix belongs by the
last-to-first mapping, and streams transform and prefixes from one sequential file into the next. Every window has its
segment's anchor inside, so an anchor is one symbol of the collection that counts for GRAM bytes of a prefix. Runs of
suffixes with a common prefix of SPAN bytes, and with one anchor, are the repeated strings.

Files: a task's two streams are spooled files, in memory up to SPOOL bytes and beyond that scratch of the running task,
like a sort's spill: nothing outlives the task and no other task reads them.

Defined results: texts are UTF-8 bytes, a null text is empty; a row with a null doc_id stays whole and is no other's
copy; repeated rows are the same document.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scanloom.llm import repeats, staging
from scanloom.llm import textkernel as tk

SPAN, GRAM = 100, 48
#: Bytes of segments that are sorted together, unless one bucket has more.
BATCH_BYTES = 256 << 10
SPOOL = 16 << 20


class _Stream:
    """A sequential file of one NumPy type: read from front to back, then replaced."""

    def __init__(self, kind: type) -> None:
        self.kind, self.file = kind, tempfile.SpooledTemporaryFile(max_size=SPOOL)

    def read(self) -> np.ndarray:
        self.file.seek(0)
        return np.frombuffer(self.file.read(), self.kind)

    def replace(self, values: np.ndarray) -> None:
        self.file.seek(0)
        self.file.write(np.ascontiguousarray(values, self.kind).tobytes())
        self.file.truncate()

    def close(self) -> None:
        self.file.close()


def collection_bwt(strings: list[bytes], cap: int, anchors: np.ndarray | None = None, weight: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The transform (0 before a whole string, else the rank of a symbol among those that occur, from 1), the common
    prefixes up to cap, and the places of the whole strings among all sorted suffixes, the empty ones first.

    anchors: of each string the place that stands for `weight` bytes; these symbols are one and come after all bytes."""
    m = len(strings)
    size = np.array([len(x) for x in strings], np.int64)
    raw = np.frombuffer(b"".join(strings), np.uint8)
    there = np.zeros(256, bool)
    there[raw] = True
    code = np.cumsum(there)
    kind = np.uint8 if code[-1] < 255 else np.uint16
    text = code.astype(kind)[raw]
    worth = np.ones(int(code[-1]) + 2, np.uint8)
    if anchors is not None:
        text[np.cumsum(size) - size + anchors] = code[-1] + 1
        worth[-1] = weight
    end = np.cumsum(size)
    symbols, prefixes = _Stream(kind), _Stream(np.uint8)
    symbols.replace(np.zeros(m))
    prefixes.replace(np.zeros(m + 1))  # one more at the end, which closes ranges
    place = np.arange(m)
    by_size = np.argsort(-size, kind="stable")
    n_live = np.searchsorted(-size[by_size], -np.arange(int(size.max(initial=0)) + 2), "right")
    owner = np.zeros(len(raw) + m, np.int32)
    for r in range(1, int(size.max(initial=0)) + 1):
        live = by_size[: n_live[r]]
        bwt, lcp = symbols.read().copy(), prefixes.read()
        here = place[live]
        symbol = text[end[live] - r]
        bwt[here] = symbol
        n = len(bwt)
        order = np.argsort(bwt, kind="stable")
        whole = m - len(live)
        last = np.zeros(n, bool)
        last[here] = True
        owner[here] = live
        at = np.flatnonzero(last[order])  # where the order has the shorter suffixes; the longer ones come after the empty ones
        here = order[at]
        live = owner[here]
        new = at + (m - whole)

        def common(first: np.ndarray, second: np.ndarray, more: np.ndarray) -> np.ndarray:
            """The symbol and the least common prefix on the way between two shorter suffixes."""
            both = np.empty(2 * len(first), np.int64)
            both[::2], both[1::2] = first, second
            both += 1
            return np.minimum(np.minimum.reduceat(lcp, both)[::2] + more, cap)

        before = order[np.maximum(at - 1, 0)]
        same = (at > 0) & (bwt[before] == bwt[here])
        more = worth[bwt[here]]
        own = np.zeros(len(live), np.uint8)
        own[same] = common(before[same], here[same], more[same])
        after = order[np.minimum(at + 1, n - 1)]
        next_same = (at + 1 < n) & (bwt[after] == bwt[here])
        old = np.ones(n + len(live), bool)
        old[new] = False
        longer, shared = np.zeros(n + len(live), kind), np.zeros(n + len(live) + 1, np.uint8)
        longer[old] = bwt
        shared[:-1][old] = lcp[:-1]
        shared[new] = own
        follow = new[next_same] + 1
        moved = common(here[next_same], after[next_same], more[next_same])
        free = old[follow]
        shared[follow[free]] = moved[free]
        others = by_size[n_live[r] :]
        if len(others):  # a place moves by the new suffixes that come before it
            place[others] += np.searchsorted(new - np.arange(len(new)), place[others], "right")
        place[live] = new
        symbols.replace(longer)
        prefixes.replace(shared)
    out = symbols.read().copy(), prefixes.read()[:-1].copy(), place
    symbols.close()
    prefixes.close()
    return out


def suffixes(bwt: np.ndarray, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The string and the offset of each sorted suffix, by walking every string from its whole to its empty suffix."""
    n, m = len(bwt), len(place)
    order = np.argsort(bwt, kind="stable")
    step = np.empty(n, np.int64)
    step[m:] = order[n - np.count_nonzero(bwt) :]
    string, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    at, live = place.copy(), np.arange(m)
    for k in range(int(size.max(initial=0)) + 1):
        string[at[live]], offset[at[live]] = live, k
        live = live[size[live] > k]
        at[live] = step[at[live]]
    return string, offset


def repeated_parts(bodies: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(body, first, last) window of the bodies that have a window whose hash occurs again: from the first such window of
    a body to its last. Equal windows have equal hashes, so what is left out has no equal."""
    size = np.array([len(x) for x in bodies], np.int64)
    many = np.maximum(size - span + 1, 0)
    owner = np.repeat(np.arange(len(bodies)), many)
    pos = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    h = tk.byte_grams(np.frombuffer(b"".join(bodies), np.uint8), span)[(np.cumsum(size) - size)[owner] + pos] if len(owner) else np.empty(0, np.uint64)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(len(h), bool)
    again[order] = np.r_[same, False][: len(h)] | np.r_[False, same][: len(h)]
    owner, pos = owner[again], pos[again]
    edge = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]][: len(owner)])
    return owner[edge], pos[edge], pos[np.r_[edge[1:], len(owner)][: len(edge)] - 1]


def earlier(classes: list[tuple[bytes, int, int]], span: int, gram: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each class (the place of its anchor, then its bytes): the offsets of its windows that occur at an earlier
    (doc_id, start) of another class."""
    some, first, last = repeated_parts([x[0][1:] for x in classes], span)
    if not len(some):
        return
    parts = [(bytes((classes[k][0][0] - a,)) + classes[k][0][1 + a : 1 + z + span], classes[k][1], classes[k][2] + a) for k, a, z in zip(some.tolist(), first.tolist(), last.tolist(), strict=True)]
    for k, windows in _earlier(parts, span, gram):
        yield int(some[k]), windows + first[k]


def _earlier(classes: list[tuple[bytes, int, int]], span: int, gram: int) -> Iterator[tuple[int, np.ndarray]]:
    anchors = np.array([x[0][0] for x in classes], np.int64)
    name: dict[bytes, int] = {}
    anchor = np.array([name.setdefault(x[0][1 + a : 1 + a + gram], len(name)) for x, a in zip(classes, anchors.tolist(), strict=True)], np.int64)
    strings = [x[0][1 : 1 + a] + b"\0" + x[0][1 + a + gram :] for x, a in zip(classes, anchors.tolist(), strict=True)]
    size = np.array([len(x) for x in strings], np.int64)
    bwt, lcp, place = collection_bwt(strings, span, anchors, gram)
    joined = np.flatnonzero(lcp >= span)
    if not len(joined):
        return
    string, offset = suffixes(bwt, place, size)
    member = np.zeros(len(lcp), bool)
    member[joined] = member[joined - 1] = True
    at = np.flatnonzero(member)
    string, offset, group = string[at], offset[at], np.cumsum(lcp[at] < span)
    doc = np.array([x[1] for x in classes], np.int64)[string]
    start = np.array([x[2] for x in classes], np.int64)[string] + offset
    by = np.lexsort((start, doc, anchor[string], group))
    string, offset, group, doc, start, anchor = string[by], offset[by], group[by], doc[by], start[by], anchor[string[by]]
    new = np.r_[True, (group[1:] != group[:-1]) | (anchor[1:] != anchor[:-1])]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (doc > doc[first]) | (start > start[first])
    string, offset = string[later], offset[later]
    if not len(string):
        return
    by = np.lexsort((offset, string))
    string, offset = string[by], offset[by]
    cuts = np.flatnonzero(np.r_[True, string[1:] != string[:-1]])
    for a, b in zip(cuts, [*cuts[1:], len(string)], strict=True):
        yield int(string[a]), offset[a:b]


def smallest(grams: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` consecutive k-gram hashes: the place of its smallest one, the leftmost of equals."""
    x = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    if done < width:
        x = np.minimum(x[: len(x) - (width - done)], x[width - done :])
    return (x & np.uint64(0xFFFFFFFF)).astype(np.int64)


def runs(ok: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First windows and numbers of windows of the segments: neighbours that are ok and have the same place."""
    if not len(ok):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = ok & np.r_[True, ~ok[:-1] | (place[1:] != place[:-1])]
    first = np.flatnonzero(new)
    total = np.r_[0, np.cumsum(ok)]
    stop = np.r_[first[1:], len(ok)]
    return first, total[stop] - total[first]


class _Bytes:
    """The two passes over blocks: buckets of all segments, and segments of buckets that occur again.

    Neighbouring windows whose smallest inner k-gram hash is the same occurrence form a segment, so every window is in
    one segment, and the bucket and a window's offset to it depend on the window's content alone."""

    def __init__(self, span: int) -> None:
        self.span, self.gram = span, min(GRAM, span)

    def _all(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = len(raw) - self.span + 1
        if n <= 0:
            return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
        grams = tk.byte_grams(raw, self.gram)
        place = smallest(grams, self.span - self.gram + 1)
        s, size = runs(repeats.inside(off, len(raw), self.span)[:n], place[:n])
        return s, size, place[s], grams[place[s]]

    def hashes(self, batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            raw, off = tk.utf8(b.column("text"))
            for i, j in tk.blocks(off):
                yield self._all(raw[off[i] : off[j]], off[i : j + 1] - off[i])[3]

    def segment(self, raw: np.ndarray, off: np.ndarray, seen: staging.Sketch) -> repeats.Segments:
        s, size, place, h = self._all(raw, off)
        again = seen.repeated(h)
        s, size, place, h = s[again], size[again], place[again], h[again]
        stop = s + size + self.span - 1
        text = raw.tobytes()

        def body(ks: np.ndarray) -> list[bytes]:
            """The place of the anchor in the content, then the content."""
            return [bytes((a,)) + text[x:y] for a, x, y in zip((place[ks] - s[ks]).tolist(), s[ks].tolist(), stop[ks].tolist(), strict=True)]

        return repeats.Segments(s, s, size, h, off, body)

    def windows(self, body: bytes) -> list[bytes]:
        return [body[x : x + self.span] for x in range(1, len(body) - self.span + 1)]


def _row(b: pa.RecordBatch, raw: np.ndarray, off: np.ndarray, gone: np.ndarray, begin: np.ndarray) -> pa.RecordBatch:
    total = np.r_[0, np.cumsum(gone)][begin]
    spans, kept = [], []
    for k in range(b.num_rows):
        text, out = raw[off[k] : off[k + 1]], gone[off[k] : off[k + 1]]
        spans.append(int(np.count_nonzero(out & ~np.r_[False, out[:-1]])) if len(out) else 0)
        kept.append((text[~out] if spans[-1] else text).tobytes())
    return pa.record_batch({"doc_id": b.column("doc_id"), "n_bytes": pa.array(np.diff(off)), "n_removed": pa.array(np.diff(total)), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary()), "kept_sha256": pa.array([sha256(x).hexdigest() for x in kept], pa.string())})


def dedup(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) and kept_sha256 of each document."""
    docs, passes = repeats.prepared(docs), _Bytes(span)
    found, cast = repeats.leaders(docs, passes.hashes, passes.segment, lambda classes: earlier(classes, span, passes.gram), BATCH_BYTES, passes.windows, 0, True)
    return repeats.removed(docs, found, cast, passes.segment, span, False, _row, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
