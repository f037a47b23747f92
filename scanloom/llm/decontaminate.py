"""Benchmark decontamination with a distributed positional inverted index.

The index is stored: a table in the shared folder with a row for each shard, a block of training documents. It has all
terms of the shard, spelled out in the order of their hashes, and for each term the ascending positions at which it
occurs, as differences. A query, a window of consecutive test words, takes the posting list of its rarest term in the
shard, shifts it by the term's place in the window and intersects it with the equally shifted lists of the other terms,
rarest first. A term is looked up by its hash and then compared by its letters. Lists are intersected where they are
stored, so no posting is shuffled, and documents are read once however large the test set is.

The test set is the stated query set; it is broadcast in blocks of at most BLOCK_BYTES of text. Each block goes over the
index; what the blocks find in a shard is put together there.

Defined results: a null or empty text has no words; an item with a null id or without words is left out; repeated
items count by their distinct ids; every input row gives one output row, repeated or null doc_id included; other columns
of the inputs are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm import staging
from scanloom.llm import textkernel as tk

#: Text of the test set that is broadcast at once; text of a shard; text for each file of the index.
BLOCK_BYTES, SHARD_BYTES, FILE_BYTES = 16 << 20, 256 << 10, 16 << 20
#: doc_ids; first (number of each document's first word, and of all words); terms (their letters) and sizes (in bytes);
#: counts (of each term) and steps (of positions, list by list). Numbers have 32 bits.
INDEX = "doc_ids array<{id}>, first binary, terms binary, sizes binary, counts binary, steps binary"


def _packed(values: np.ndarray) -> bytes:
    return values.astype("<u4").tobytes()


def _numbers(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u4").astype(np.int64)


def posted(raw: np.ndarray, off: np.ndarray) -> dict[str, bytes]:
    """The index of one shard, but for its doc_ids.

    A position counts words over the shard and one more between documents, so that no phrase crosses from one to the next.
    """
    raw = tk.lowered(raw)
    starts, ends, first = tk.word_bounds(raw, off, "alnum")
    h = tk.span_hashes(raw, starts, ends, lower=False)
    order = np.argsort(h, kind="stable")
    new = np.r_[True, h[order][1:] != h[order][:-1]][: len(h)]
    sample = order[new][np.cumsum(new) - 1]
    if not tk.same_spans(raw, starts[order], ends[order], raw, starts[sample], ends[sample]).all():  # words that share a hash
        word = [raw[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        order = np.array(sorted(range(len(h)), key=lambda k: (int(h[k]), word[k], k)))
        new = np.array([True, *(word[a] != word[b] for a, b in zip(order[1:].tolist(), order[:-1].tolist(), strict=True))])
    place = np.arange(len(h)) + np.repeat(np.arange(len(off) - 1), np.diff(first))
    step = np.diff(place[order], prepend=0)
    step[new] = place[order][new]
    some = order[new]
    text, _ = tk.joined(raw, starts[some], ends[some], 0)
    counts = np.diff(np.r_[np.flatnonzero(new), len(h)])
    return {"first": _packed(first), "terms": text.tobytes(), "sizes": _packed(ends[some] - starts[some]), "counts": _packed(counts), "steps": _packed(step)}


def index(docs: DataFrame) -> DataFrame:
    """The stored index of docs (doc_id, text), one row for each shard, with a number of its own."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = tk.utf8(b.column("text"))
            for i, j in tk.blocks(off, SHARD_BYTES):
                ids = b.column("doc_id").slice(i, j - i)
                row = posted(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.record_batch({"doc_ids": pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), ids), **{k: pa.array([v], pa.binary()) for k, v in row.items()}})

    rows = docs.mapInArrow(build, INDEX.format(id=kind)).withColumn("shard", F.monotonically_increasing_id())
    return staging.staged(rows, "postings", max(24, staging.files_for(staging.input_bytes(docs), FILE_BYTES)))


class Queries:
    """Windows of test words as rows of term numbers, and the terms: hashes, letters."""

    def __init__(self, ids: list[int], texts: list[str], n: int) -> None:
        raw, off = tk.utf8(pa.array(texts, pa.string()))
        raw = tk.lowered(raw)
        starts, ends, first = tk.word_bounds(raw, off, "alnum")
        number: dict[bytes, int] = {}
        term = np.array([number.setdefault(raw[a:b].tobytes(), len(number)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
        self.n, self.n_terms = n, len(number)
        size = np.array([len(w) for w in number], np.int64)
        self.text, self.ends = np.frombuffer(b"".join(number), np.uint8), np.cumsum(size)
        self.starts = self.ends - size
        self.hashes = tk.span_hashes(self.text, self.starts, self.ends, lower=False)
        of: dict[tuple[int, ...], set[int]] = {}
        for i, item in enumerate(ids):
            words = term[first[i] : first[i + 1]].tolist()
            for k in range(max(1, len(words) - n + 1) if words else 0):
                of.setdefault(tuple(words[k : k + n]), set()).add(item)
        self.windows = np.full((len(of), n), -1, np.int64)
        self.length = np.array([len(w) for w in of], np.int64)
        for k, w in enumerate(of):
            self.windows[k, : len(w)] = w
        self.items = [sorted(x) for x in of.values()]


class Shard:
    """The posting lists of a stored shard that the terms of a test set ask for."""

    def __init__(self, row: dict[str, bytes], q: Queries) -> None:
        self.first, sizes, counts, step = (_numbers(row[c]) for c in ("first", "sizes", "counts", "steps"))
        begin, ends, text = np.r_[0, np.cumsum(counts)], np.cumsum(sizes), np.frombuffer(row["terms"], np.uint8)
        starts = ends - sizes
        terms = tk.span_hashes(text, starts, ends, lower=False)
        self.span = len(step) + len(self.first) + 1
        want = np.arange(q.n_terms)
        at = np.searchsorted(terms, q.hashes)
        lists = np.full(q.n_terms, -1, np.int64)
        while len(want):  # several rounds only for words that share a hash
            ok = at < len(terms)
            want, at = want[ok], at[ok]
            ok = terms[at] == q.hashes[want]
            want, at = want[ok], at[ok]
            same = tk.same_spans(q.text, q.starts[want], q.ends[want], text, starts[at], ends[at])
            lists[want[same]] = at[same]
            want, at = want[~same], at[~same] + 1
        there = np.flatnonzero(lists >= 0)
        self.count = np.zeros(q.n_terms, np.int64)
        self.count[there] = counts[lists[there]]
        self.begin = np.r_[0, np.cumsum(self.count)]
        n = self.count[there]
        from_ = np.repeat(begin[lists[there]], n)
        post = from_ + np.arange(len(from_)) - np.repeat(np.cumsum(n) - n, n)
        total = np.cumsum(step)
        self.key = np.repeat(there, n) * self.span + total[post] - total[from_] + step[from_]

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = term * self.span + place
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return (self.key[at] == key) & (place >= 0)

    def anchored(self, q: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows all of whose terms occur, with the order of their terms by rarity, and the postings of the rarest."""
        if not len(self.key) or not len(q.windows):
            return (np.empty(0, np.int64),) * 2 + (np.empty((0, q.n), np.int64),)
        often = np.where(q.windows >= 0, self.count[q.windows], np.iinfo(np.int64).max)
        live = np.flatnonzero(often.min(axis=1) > 0)
        rare = np.argsort(often[live], axis=1, kind="stable")
        anchor = q.windows[live, rare[:, 0]]
        n = self.count[anchor]
        row = np.repeat(np.arange(len(live)), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        place = self.key[self.begin[anchor][row] + nth] - anchor[row] * self.span
        return live[row], place, rare[row]

    def phrases(self, q: Queries) -> tuple[np.ndarray, np.ndarray]:
        """Exact occurrences: the window and the position of its first word."""
        window, place, rare = self.anchored(q)
        start = place - (rare[:, 0] if len(rare) else 0)
        for k in range(1, q.n):
            if not len(window):
                break
            offset = rare[:, k]
            term = q.windows[window, offset]
            ok = (term < 0) | self.has(np.maximum(term, 0), start + offset)
            window, start, rare = window[ok], start[ok], rare[ok]
        return window, start

    def near(self, q: Queries, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Proximity: places of a window's rarest term with every other term at most slop words away, in any order."""
        window, place, rare = self.anchored(q)
        for k in range(1, q.n):
            if not len(window):
                break
            term = q.windows[window, rare[:, k]]
            low = np.maximum(term, 0) * self.span + np.maximum(place - slop, 0)
            at = np.minimum(np.searchsorted(self.key, low), len(self.key) - 1)
            ok = (term < 0) | ((self.key[at] >= low) & (self.key[at] <= low + np.minimum(place, slop) + slop))
            window, place, rare = window[ok], place[ok], rare[ok]
        return window, place

    def doc_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first[1:] + np.arange(1, len(self.first)), place, "right")


def _hits(batch: pa.RecordBatch, q: Queries, slop: int | None) -> Iterator[pa.RecordBatch]:
    """For each stored shard its documents with their hits."""
    names = [x for x in batch.schema.names if x not in ("shard", "doc_ids")]
    for k in range(batch.num_rows):
        shard = Shard({x: batch.column(x)[k].as_buffer() for x in names}, q)
        window, start = shard.phrases(q) if slop is None else shard.near(q, slop)
        doc = shard.doc_of(start)
        word = start - doc  # back to a number of a word in the shard
        n_docs, n_words = len(shard.first) - 1, int(shard.first[-1])
        stop = word + (q.length[window] if slop is None else 1)
        hit = np.cumsum(np.bincount(word, minlength=n_words + 1) - np.bincount(stop, minlength=n_words + 1))[:n_words] > 0
        bits, items = [b""] * n_docs, [[]] * n_docs
        for d in np.unique(doc):
            bits[d] = np.packbits(hit[shard.first[d] : shard.first[d + 1]]).tobytes()
            items[d] = sorted({x for w in np.unique(window[doc == d]) for x in q.items[w]})
        n_hit = np.diff(np.r_[0, np.cumsum(hit)][shard.first])
        yield pa.record_batch({"shard": pa.array([batch.column("shard")[k].as_py()] * n_docs, pa.int64()), "nth": pa.array(np.arange(n_docs, dtype=np.int32)), "doc_id": batch.column("doc_ids")[k].values, "n_words": pa.array(np.diff(shard.first)), "n_hit": pa.array(n_hit), "items": pa.array(items, pa.list_(pa.int64())), "hit_bits": pa.array(bits, pa.binary())})


HITS = "shard long, nth int, doc_id {id}, n_words long, n_hit long, items array<long>, hit_bits binary"
RESULT = ["doc_id", "n_words", "n_hit", "items", "hit_bits"]


def search(stored: DataFrame, benchmark: DataFrame, n: int = 10, slop: int | None = None) -> DataFrame:
    """The documents of a stored index with their hits: n_words, n_hit, items (ids of those with occurring windows) and
    hit_bits (a bit per word).

    slop: with a number, proximity instead of exact phrases: the hit is the place of a window's rarest term.
    """
    spark = stored.sparkSession
    schema = HITS.format(id=stored.schema["doc_ids"].dataType.elementType.simpleString())
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(size / BLOCK_BYTES))

    def over(block: int) -> DataFrame:
        rows = tests.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block).collect()  # about BLOCK_BYTES
        cast = spark.sparkContext.broadcast(([r.item_id for r in rows], [r.text for r in rows]))
        made: list[Queries] = []

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not made:
                made.append(Queries(*cast.value, n))
            for b in batches:
                yield from _hits(b, made[0], slop)

        return stored.mapInArrow(run, schema)

    if n_blocks == 1:
        return over(0).select(RESULT)
    every = over(0)
    for block in range(1, n_blocks):
        every = every.unionByName(over(block).where("n_hit > 0"))

    def merged(t: pa.Table) -> pa.Table:
        n = t["n_words"][0].as_py()
        bits = np.zeros((n + 7) // 8, np.uint8)
        for b in t["hit_bits"].to_pylist():
            if b:
                bits |= np.frombuffer(b, np.uint8)
        items = sorted({x for y in t["items"].to_pylist() for x in y})
        n_hit = int(np.unpackbits(bits)[:n].sum())
        return pa.table({"doc_id": t["doc_id"].slice(0, 1), "n_words": pa.array([n]), "n_hit": pa.array([n_hit]), "items": pa.array([items], pa.list_(pa.int64())), "hit_bits": pa.array([bits.tobytes() if items else b""], pa.binary())})

    return every.groupBy("shard", "nth").applyInArrow(merged, schema.partition("nth int, ")[2])


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, slop: int | None = None) -> DataFrame:
    """search() over the index of the documents, which is stored first: one row for each document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return search(index(rows), benchmark, n, slop)


def digest(hits: DataFrame) -> DataFrame:
    """The columns of the op4 contract."""
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The documents, with all their columns, that have no word inside an occurrence of a test window.

    What a text has is a matter of the text alone, so rows are told by its digest: rows without an id, or with one that
    others have too, stay or go by their own text."""
    text = F.col("text").cast("string")
    hits = search(index(docs.select(F.sha2(text, 256).alias("doc_id"), text.alias("text"))), benchmark, n)
    bad = hits.where("n_hit > 0").select(F.col("doc_id").alias("bad_text")).distinct()
    return docs.join(bad, F.sha2(docs["text"].cast("string"), 256) == bad["bad_text"], "left_anti")
