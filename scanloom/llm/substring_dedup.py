"""Substring deduplication over words with difference-cover anchors.

D is a difference cover modulo P: for any two places i and j there is a shift below P that brings both onto D. Hashes of
anchor windows are therefore taken at places on D only, |D| of every P, and two equal stretches of SPAN words always
share an anchor of SPAN - P + 1 words at aligned places on D. A bounded sketch says which anchors occur again.

Anchors that occur again meet by their hash, each with the words around it that a match of SPAN words can reach, P - 1 to
either side; occurrences with the same surroundings are one class (see repeats.py). From the anchor the match is extended
word by word, to the right and to the left, and a class stays with those that still agree with it: groups of equal
extensions split until a class is alone. A window of SPAN words has an earlier equal if the extensions on both its sides
reach a class of an earlier document. Words are compared, not hashes.

Defined results: a null text has no words; a row with a null doc_id is neither earlier nor later than others and stays
whole; repeated rows are the same document; a document shorter than SPAN words stays whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scanloom.llm import repeats, staging
from scanloom.llm import textkernel as tk

#: A perfect difference set, in which each difference modulo 31 occurs once.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Bytes of classes that are extended together, unless one bucket has more.
BATCH_BYTES = 2 << 20


def _anchors(words: np.ndarray, first: np.ndarray, anchor: int, period: int, cover: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Places (in words of the block) on the cover, and the hashes of their anchor windows."""
    h = tk.window_hashes(words, anchor)
    within = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))[: len(h)]
    on = np.zeros(period, bool)
    on[list(cover)] = True
    at = np.flatnonzero(on[within % period] & repeats.inside(first, len(words), anchor)[: len(h)])
    return at, h[at]


class _Cover:
    """The two passes over blocks that a cover asks for."""

    def __init__(self, span: int, period: int, cover: tuple[int, ...]) -> None:
        if not period <= min(span, 256):
            raise ValueError("a cover's period is at most the window's length and 256")
        self.span, self.period, self.cover, self.anchor = span, period, cover, span - period + 1

    def hashes(self, batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            raw, off = tk.utf8(b.column("text"))
            for i, j in tk.blocks(off):
                text, begin = raw[off[i] : off[j]], off[i : j + 1] - off[i]
                starts, ends, first = tk.word_bounds(text, begin, "space")
                yield _anchors(tk.span_hashes(text, starts, ends, lower=False), first, self.anchor, self.period, self.cover)[1]

    def segment(self, raw: np.ndarray, off: np.ndarray, seen: staging.Sketch) -> repeats.Segments:
        """For each anchor that occurs again, the windows of its document that hold it."""
        starts, ends, first = tk.word_bounds(raw, off, "space")
        at, h = _anchors(tk.span_hashes(raw, starts, ends, lower=False), first, self.anchor, self.period, self.cover)
        again = seen.repeated(h)
        at, h = at[again], h[again]
        doc = np.searchsorted(first, at, "right") - 1
        s = np.maximum(at - self.period + 1, first[doc])
        n = np.minimum(at, first[doc + 1] - self.span) - s + 1
        ok = n > 0
        at, h, s, n = at[ok], h[ok], s[ok], n[ok]
        # the words of the block, one space after each: contents are slices of this
        flat, to = tk.joined(raw, starts, ends, 1)
        text, stop = flat.tobytes(), to + ends - starts

        def body(ks: np.ndarray) -> list[bytes]:
            """The place of the anchor in the content, then its words: the same words around another place are another class."""
            return [bytes((a,)) + text[x:y] for a, x, y in zip((at[ks] - s[ks]).tolist(), to[s[ks]].tolist(), stop[s[ks] + n[ks] + self.span - 2].tolist(), strict=True)]

        return repeats.Segments(at, s, n, h, first, body)

    def windows(self, body: bytes) -> list[bytes]:
        words = body[1:].split(b" ")
        return [b" ".join(words[k : k + self.span]) for k in range(len(words) - self.span + 1)]


def _split(group: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Groups after one more word: classes of a group with the same word stay together; -1 for a class that is alone or
    at its end."""
    out = np.full(len(group), -1, np.int64)
    live = np.flatnonzero((group >= 0) & (word > 0))
    _, name, count = np.unique(group[live] << 32 | word[live], return_inverse=True, return_counts=True)
    out[live] = np.where(count[name] > 1, name, -1)
    return out


def extended(classes: list[tuple[bytes, int, int]], span: int, anchor: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each class: its windows whose words are also around the anchor of a class of an earlier document."""
    reach = span - anchor
    table = np.zeros((len(classes), reach + span), np.int64)  # a class in each row, the anchor's first word in column reach
    number: dict[bytes, int] = {}
    before = np.array([x[0][0] for x in classes], np.int64)
    for k, (body, _, _) in enumerate(classes):
        words = [number.setdefault(w, len(number) + 1) for w in body[1:].split(b" ")]
        table[k, reach - before[k] : reach - before[k] + len(words)] = words
    lead = np.array([x[1] for x in classes], np.int64)
    group = np.zeros(len(classes), np.int64)
    for k in range(anchor):
        group = _split(group, table[:, reach + k])
    left, right = [group], [group]
    for k in range(reach):
        left.append(_split(left[-1], table[:, reach - 1 - k]))
        right.append(_split(right[-1], table[:, reach + anchor + k]))
    found = np.zeros((len(classes), reach + 1), bool)
    for ahead in range(reach + 1):  # a window that starts so many words before the anchor
        a, b = left[ahead], right[reach - ahead]
        live = np.flatnonzero((a >= 0) & (b >= 0))
        if len(live):
            _, name = np.unique(a[live] << 32 | b[live], return_inverse=True)
            least = np.full(name.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, name, lead[live])
            found[live, ahead] = least[name] < lead[live]
    for k in np.flatnonzero(found.any(axis=1)).tolist():
        yield k, before[k] - np.flatnonzero(found[k])[::-1]


def _row(b: pa.RecordBatch, raw: np.ndarray, off: np.ndarray, gone: np.ndarray, begin: np.ndarray) -> pa.RecordBatch:
    total = np.r_[0, np.cumsum(gone)][begin]
    kept = []
    for k in range(b.num_rows):
        words = raw[off[k] : off[k + 1]].tobytes().split()
        if total[k + 1] > total[k]:
            words = [w for w, g in zip(words, gone[begin[k] : begin[k + 1]].tolist(), strict=True) if not g]
        kept.append(b" ".join(words))
    return pa.record_batch({"doc_id": b.column("doc_id"), "n_words": pa.array(np.diff(begin)), "n_removed": pa.array(np.diff(total)), "text": pa.array([x.decode() for x in kept], pa.string()), "kept_sha256": pa.array([sha256(x).hexdigest() for x in kept], pa.string())})


def dedup(docs: DataFrame, span: int = 50, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """doc_id, n_words, n_removed, text (the kept words, joined by one space) and kept_sha256 of each document."""
    docs, passes = repeats.prepared(docs), _Cover(span, period, cover)
    found, cast = repeats.leaders(docs, passes.hashes, passes.segment, lambda classes: extended(classes, span, passes.anchor), BATCH_BYTES, passes.windows, period - 1, False)
    return repeats.removed(docs, found, cast, passes.segment, span, True, _row, "doc_id long, n_words long, n_removed long, text string, kept_sha256 string")
