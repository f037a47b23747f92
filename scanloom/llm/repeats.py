"""What the two substring operators share: segments of windows, their classes, and what later occurrences lose.

A window is `span` consecutive units (bytes or words) of one document. A segment is a run of windows around an anchor;
the anchor's hash is its bucket. An operator chooses anchors so that equal windows, wherever they stand, are at the same
offset to an equal anchor in at least one segment each. Segments with the same content form a class, whose leader is its
first occurrence: copies, however many, meet as one partial minimum for each map task. Only buckets with several classes
need their windows compared, class by class and not copy by copy.

A document then only needs to know its leaders: every other candidate segment of it occurs earlier as a whole, and
of a leader those windows that the comparison found in an earlier class. So no row is ever sent for a copy.

A bucket is one task's work unless it has very many classes, as the surroundings of a passage have that very many
documents share. The classes of such a bucket are dealt out one by one, and become a row for each of their windows; these
rows meet as partial minima, so no task holds the bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm import staging
from scanloom.llm import textkernel as tk

#: Classes whose content a map task remembers to have handed on; forgetting them costs a repeated row, no result.
REMEMBERED = 100_000
#: Logarithm of the number of classes from which a bucket is compared by rows.
HOT = 12
#: Bytes of text for each file of classes.
FILE_BYTES = 16 << 20


@dataclass
class Segments:
    """Candidate segments of a block of documents, in the order of their anchors. at: place of the anchor, as a unit of
    the block; s: first window; n: windows; h: bucket; begin: first unit of each document, and the number of units.

    body: contents, equal for segments of a class and for no others."""

    at: np.ndarray
    s: np.ndarray
    n: np.ndarray
    h: np.ndarray
    begin: np.ndarray
    body: Callable[[np.ndarray], list[bytes]]

    @property
    def doc(self) -> np.ndarray:
        return np.searchsorted(self.begin, self.at, "right") - 1


Segmenter = Callable[[np.ndarray, np.ndarray, staging.Sketch], Segments]
Resolver = Callable[[list[tuple[bytes, int, int]]], Iterator[tuple[int, np.ndarray]]]


def prepared(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def inside(off: np.ndarray, n: int, span: int) -> np.ndarray:
    """True for starts of windows that lie in one document; off: the documents' first units, and the number of all."""
    size = np.maximum(np.diff(off) - span + 1, 0)
    return _covered(off[:-1], off[:-1] + size, n) > 0


def _covered(first: np.ndarray, stop: np.ndarray, n: int) -> np.ndarray:
    """How many of the ranges each of n places is in."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, first, 1)
    np.subtract.at(edge, stop, 1)
    return np.cumsum(edge[:-1], dtype=np.int32)


def digests(bodies: list[bytes], numbers: int) -> np.ndarray:
    """So many 64-bit numbers for each content."""
    return np.frombuffer(b"".join([blake2b(x, digest_size=8 * numbers).digest() for x in bodies]), np.int64).reshape(-1, numbers)


def _over(docs: DataFrame, segment: Segmenter, cast, wanted: Callable[[np.ndarray], np.ndarray] | None, row: Callable, schema: str) -> DataFrame:
    """mapInArrow over the candidate segments of documents with an id. wanted: of those buckets only, and of each class
    only the first segment that a task sees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = staging.with_sketch(cast)
        known: set[bytes] = set()
        for b in batches:
            raw, off = tk.utf8(b.column("text"))
            ids = b.column("doc_id")
            named, number = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for i, j in tk.blocks(off):
                g = segment(raw[off[i] : off[j]], off[i : j + 1] - off[i], seen)
                doc = g.doc
                ok = named[i:j][doc]
                if wanted:
                    ok &= wanted(g.h)
                at = np.flatnonzero(ok)
                bodies = g.body(at)
                if wanted:  # a content that this task has handed on need not be sent again
                    if len(known) > REMEMBERED:
                        known.clear()
                    fresh = []
                    for k, x in enumerate(bodies):
                        if x not in known:
                            known.add(x)
                            fresh.append(k)
                    at, bodies = at[fresh], [bodies[k] for k in fresh]
                if len(at):
                    yield row(g.h[at].view(np.int64), digests(bodies, 1)[:, 0], bodies, number[i:j][doc[at]], (g.at - g.begin[doc])[at].astype(np.int32))

    return docs.mapInArrow(run, schema)


def _places(h, c, bodies, doc, p) -> pa.RecordBatch:
    return pa.record_batch({"h": pa.array(h), "c": pa.array(c), "doc_id": pa.array(doc), "p": pa.array(p)})


#: A leader's name inside its document: the place of its anchor, and half of the bucket's hash, which tells texts apart
#: that share a doc_id.
KEY = "shiftleft(cast(p as long), 32) | (h & 4294967295)"
INNER = "array<struct<a:int,b:int>>"


def leaders(docs: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], segment: Segmenter, resolver: Resolver, batch_bytes: int, windows: Callable[[bytes], list[bytes]], before: int, inside_document: bool):
    """(table of the leaders, broadcast sketch of the buckets). A row: doc_id, key and inner, windows (a to b) of the
    segment that occur in an earlier class.

    hashes: what to count to find candidates. resolver: gets classes (content, doc_id and start of the leader) of whole
    buckets and gives (number of the class, windows that have an earlier equal); it sees about batch_bytes, or one
    bucket. windows: the windows of a content. before: how many units before its anchor a segment starts, if its document
    does not start later. inside_document: an earlier start in the same document is earlier.
    """
    parts, log = staging.slices(docs), staging.log_bits(docs)
    cast = staging.sketch(docs.mapInArrow(lambda it: staging.packed(hashes(it), parts), staging.PACKED), parts, log)
    # a class goes by its anchor's hash and a digest of its content, 128 bits together
    places = _over(docs, segment, cast, None, _places, "h long, c long, doc_id long, p int")
    classes = places.groupBy("h", "c").agg(F.min(F.struct("doc_id", "p")).alias("lead")).select("h", "c", "lead.*")
    classes = staging.staged(classes, "classes", max(24, staging.files_for(staging.input_bytes(docs), FILE_BYTES)))
    # classes are distinct, so a bucket that is counted twice has several
    counted = staging.sketch(classes.select("h").mapInArrow(lambda it: staging.packed((x.column("h").to_numpy().view(np.uint64) for x in it), parts), staging.PACKED), parts, log)

    def kind(h: np.ndarray) -> np.ndarray:
        """0 for buckets of one class, 1 for those of several, 2 for those of very many."""
        order = staging.with_sketch(counted).order(h)
        return (order > 0).astype(np.int8) + (order >= HOT)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield x.filter(pa.array(kind(x.column("h").to_numpy().view(np.uint64)) == 0))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            k = kind(x.column("h").to_numpy().view(np.uint64))
            some = pa.array(k > 0)
            yield x.append_column("hot", pa.array(k > 1)).filter(some)

    def content(h, c, bodies, doc, p) -> pa.RecordBatch:
        return pa.record_batch({"h": pa.array(h), "c": pa.array(c), "body": pa.array(bodies, pa.binary()), "hot": pa.array(kind(h.view(np.uint64)) > 1)})

    contents = _over(docs, segment, cast, lambda h: kind(h) > 0, content, "h long, c long, body binary, hot boolean")
    own = classes.mapInArrow(shared, "h long, c long, doc_id long, p int, hot boolean")
    mixed = own.withColumn("body", F.lit(None).cast("binary")).unionByName(contents, allowMissingColumns=True)
    place = F.when(F.col("hot"), F.xxhash64("h", "c")).otherwise(F.col("h"))
    rows = mixed.withColumn("at", place).repartition(4 * parts, "at").sortWithinPartitions("h", "c", F.col("doc_id").asc_nulls_last())

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # classes of whole buckets, but for the last one
        size, tail = 0, None

        def flush(some: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(some)
            inner: list[list[dict]] = [[] for _ in range(t.num_rows)]
            for k, windows in resolver(list(zip(*(t.column(c).to_pylist() for c in ("body", "doc_id", "s")), strict=True))):
                cut = np.flatnonzero(np.diff(windows) > 1)
                inner[k] = [{"a": a, "b": b} for a, b in zip(windows[np.r_[0, cut + 1]].tolist(), windows[np.r_[cut, len(windows) - 1]].tolist(), strict=True)]
            none = pa.nulls(t.num_rows, pa.int64())
            yield pa.record_batch({"doc_id": t.column("doc_id").combine_chunks(), "key": t.column("key").combine_chunks(), "inner": pa.array(inner, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), "s": pa.nulls(t.num_rows, pa.int32()), "k": pa.nulls(t.num_rows, pa.int32()), "w1": none, "w2": none})

        def opened(some: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            """Rows of the windows of classes."""
            for part in pieces(some, 1024):
                each = [windows(x) for x in part.column("body").to_pylist()]
                n = np.array([len(x) for x in each], np.int64)
                row = np.repeat(np.arange(len(each)), n)
                w = digests([x for y in each for x in y], 2)
                k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                at = pa.array(row)
                yield pa.record_batch({"doc_id": part.column("doc_id").take(at), "key": part.column("key").take(at), "inner": pa.nulls(len(row), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), "s": part.column("s").take(at), "k": pa.array(k.astype(np.int32)), "w1": pa.array(w[:, 0]), "w2": pa.array(w[:, 1])})

        def sorted_out(some: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            """Of classes with their contents: those of hot buckets as rows, the others held until their bucket is whole."""
            nonlocal held, size
            hot = some.column("hot")
            if pc.any(hot).as_py():
                yield from opened(some.filter(hot))
                some = some.filter(pc.invert(hot))
            if not some.num_rows:
                return
            h = some.column("h").to_numpy()
            edge = np.flatnonzero(np.r_[held[-1].column("h")[-1].as_py() != h[0] if held else False, h[1:] != h[:-1]])
            begin, total = 0, np.r_[0, np.cumsum(pc.binary_length(some.column("body")).to_numpy())]
            for e in edge.tolist():  # where a bucket begins
                if size + total[e] - total[begin] >= batch_bytes:
                    if e > begin:
                        held.append(some.slice(begin, e - begin))
                    yield from flush(held)
                    held, size, begin = [], 0, e
            held.append(some.slice(begin))
            size += total[-1] - total[begin]

        for b in batches:
            if tail is not None:
                b = pa.Table.from_batches([tail, b]).combine_chunks().to_batches()[0]
            # a class's own row comes first, then its content from one task or several
            own = np.flatnonzero(~b.column("body").is_valid().to_numpy(zero_copy_only=False))
            if not len(own):
                continue
            tail = b.slice(own[-1], 2)  # its content may be the next batch's first row
            own = own[:-1]
            if not len(own):
                continue
            part = b.take(pa.array(own))
            yield from sorted_out(part.set_column(part.schema.get_field_index("body"), "body", b.column("body").take(pa.array(own + 1))))
        if tail is not None:
            last = tail.slice(0, 1)
            yield from sorted_out(last.set_column(last.schema.get_field_index("body"), "body", tail.column("body").slice(1, 1)))
        if held:
            yield from flush(held)

    found = rows.select("h", "doc_id", F.expr(KEY).alias("key"), F.greatest(F.col("p") - before, F.lit(0)).alias("s"), "hot", "body").mapInArrow(resolve, f"doc_id long, key long, inner {INNER}, s int, k int, w1 long, w2 long")
    found = staging.staged(found, "leaders", max(24, staging.files_for(staging.input_bytes(docs), FILE_BYTES)))
    leads = classes.mapInArrow(alone, classes.schema).select("doc_id", F.expr(KEY).alias("key"), F.lit(None).cast(INNER).alias("inner"))
    leads = leads.unionByName(found.where("w1 is null").select("doc_id", "key", "inner"))
    return leads.unionByName(_by_rows(found.where("w1 is not null"), inside_document)), cast


def _by_rows(windows: DataFrame, inside_document: bool) -> DataFrame:
    """The leaders of very large buckets, from a row for each window of a class."""
    each = windows.withColumn("place", F.struct("doc_id", (F.col("s") + F.col("k")) if inside_document else F.lit(0).alias("o")))
    first = each.groupBy("w1", "w2").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").toDF("v1", "v2", "first", "n")
    later = each.join(first, (F.col("w1") == F.col("v1")) & (F.col("w2") == F.col("v2")) & (F.col("place") > F.col("first")))
    inner = later.groupBy("doc_id", "key").agg(F.collect_set(F.struct(F.col("k").alias("a"), F.col("k").alias("b"))).cast(INNER).alias("inner"))
    return windows.select("doc_id", "key").distinct().join(inner, ["doc_id", "key"], "left")


def pieces(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, most):
        yield batch.slice(k, most)


def _again(g: Segments, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leader, segment) of other segments of a leader's document with the leader's content; at: the leaders' segments."""
    of: dict[tuple[int, int], list[int]] = {}
    many = np.flatnonzero(np.bincount(doc, minlength=1)[doc] > 1)
    for k, x, d in zip(many.tolist(), g.h[many].tolist(), doc[many].tolist(), strict=True):
        of.setdefault((d, x), []).append(k)
    out = []
    for n, q in enumerate(at.tolist()):
        others = of.get((int(doc[q]), int(g.h[q])), ())
        if len(others) > 1:
            bodies = g.body(np.array([q, *others]))
            out += [(n, k) for k, body in zip(others, bodies[1:], strict=True) if k != q and body == bodies[0]]
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _named(g: Segments, begin: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the segment, whether it is there) for names of leaders in the documents that begin there."""
    if not len(g.at):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    place = begin + (key >> 32)
    at = np.minimum(np.searchsorted(g.at, place), len(g.at) - 1)
    return at, (g.at[at] == place) & ((g.h[at] & np.uint64(0xFFFFFFFF)) == (key & 0xFFFFFFFF).astype(np.uint64))


def removed(docs: DataFrame, found: DataFrame, cast, segment: Segmenter, span: int, each: bool, row: Callable, schema: str) -> DataFrame:
    """docs through row(batch, raw, off, gone, begin): gone has a bit for each unit of a block of rows.

    each: all of a document's segments with a leader's content stay, not only the first.
    """
    some = F.size("inner") > 0
    of = found.groupBy(F.col("doc_id").alias("d")).agg(F.collect_list(F.when(~F.coalesce(some, F.lit(False)), F.col("key"))).alias("whole"), F.collect_list(F.when(some, F.struct("key", "inner"))).alias("part"))
    both = docs.join(of, docs["doc_id"] == of["d"], "left").select("doc_id", "text", "whole", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = staging.with_sketch(cast)
        for b in (p for x in batches for p in pieces(x, 1024)):
            raw, off = tk.utf8(b.column("text"))
            named = b.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            for i, j in tk.blocks(off):
                part = b.slice(i, j - i)
                text, begin = raw[off[i] : off[j]], off[i : j + 1] - off[i]
                g = segment(text, begin, seen)
                doc, n_units = g.doc, int(g.begin[-1])
                ok = named[i:j][doc]
                # windows of candidate segments, less those of leaders, and again what an earlier class has of leaders
                often = _covered(g.s[ok], g.s[ok] + g.n[ok], n_units)
                whole, parted = part.column("whole"), part.column("part")
                n_whole, n_part = (np.diff(x.offsets.to_numpy()) if len(x) else np.empty(0, np.int64) for x in (whole, parted))
                inner = parted.flatten()
                key = np.r_[whole.flatten().to_numpy(), inner.field("key").to_numpy()]
                owner = np.r_[np.repeat(np.arange(j - i), n_whole), np.repeat(np.arange(j - i), n_part)]
                at, real = _named(g, g.begin[:-1][owner], key)
                lists = inner.field("inner")
                n_ranges = np.r_[np.zeros(int(n_whole.sum()), np.int64), np.diff(lists.offsets.to_numpy()) if len(lists) else np.empty(0, np.int64)]
                ranges = lists.flatten()
                a, z = ranges.field("a").to_numpy(), ranges.field("b").to_numpy()
                from_range = np.cumsum(n_ranges) - n_ranges
                lead = np.flatnonzero(real)
                if each:
                    n, k = _again(g, at[lead], doc)
                    lead, at = np.r_[lead, lead[n]], np.r_[at[lead], k]
                else:
                    at = at[lead]
                often -= _covered(g.s[at], g.s[at] + g.n[at], n_units)
                count = n_ranges[lead]
                r = np.repeat(from_range[lead], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                base = np.repeat(g.s[at], count)
                often += _covered(base + a[r], base + z[r] + 1, n_units)
                starts = np.flatnonzero(often > 0)
                yield row(part, text, begin, _covered(starts, starts + span, n_units) > 0, g.begin)

    return both.mapInArrow(run, schema)
