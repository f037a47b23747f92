"""Conflict-constrained best-fit packing of documents into bins of `capacity` words.

Pieces (whole documents, or runs of a longer one) are taken longest first. Open bins are ordered by residual capacity;
the search starts at the successor of the piece's length and goes on until the tightest compatible bin is found. A bin
carries bitmaps of its sources, one for each of `per_source` allowed occurrences, and of its duplicate clusters. A
source or cluster with a large share of a shard has an ordered list of the bins that are still open to it, so that a
search never walks past all the bins that it has filled.

Best fit is sequential; it runs in shards that pieces are dealt to by a hash of doc_id and piece, with a number of
shards that follows the words and pieces of the input. A shard holds a bounded number of pieces whatever the skew: no
source or cluster is kept together. Bins of different shards never share documents, so constraints hold globally.

The duplicate cluster of a document is by default the sequence of its words in lower case: exact copies and those that
differ in letter case or white space conflict, edited copies do not unless a column says so.

Defined results: a document without words has one row with piece 0, no words and no bin; null sources and clusters
conflict with nothing; repeated rows are pieces of their own (and conflict, having one cluster); a null doc_id is dealt
like a value.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm import staging
from scanloom.llm import textkernel as tk

CAPACITY, PER_SOURCE = 2048, 2
#: Words and pieces of a shard.
SHARD_WORDS, SHARD_PIECES = 4 << 20, 20_000
#: A source or cluster with such a share of a shard's pieces has its own list of bins.
HOT = 0.04
#: Bytes of text for each file of word counts.
FILE_BYTES = 64 << 20


def best_fit(pieces: list[tuple[int, object, object]], capacity: int, per_source: int) -> list[int]:
    """The bin of each piece (length, source, cluster); pieces come longest first."""
    bit = {k: 1 << n for n, k in enumerate(dict.fromkeys(x[1] for x in pieces if x[1] is not None))}
    copies = Counter(x[2] for x in pieces if x[2] is not None)
    cluster_bit = {k: 1 << n for n, k in enumerate(k for k, c in copies.items() if c > 1)}
    sources = Counter(x[1] for x in pieces if x[1] is not None)
    most = max(64, HOT * len(pieces))
    hot = {(0, k) for k, c in sources.items() if c > most} | {(1, k) for k, c in copies.items() if c > most}
    every: list[tuple[int, int]] = []
    lists: dict[tuple[int, object], list[tuple[int, int]]] = {k: [] for k in hot}
    residual: list[int] = []
    masks: list[list[int]] = []  # a bitmap of sources for each allowed occurrence
    clusters: list[int] = []

    def admits(b: int, key: tuple[int, object]) -> bool:
        return not (masks[b][-1] & bit[key[1]] if key[0] == 0 else clusters[b] & cluster_bit[key[1]])

    def take_out(ordered: list[tuple[int, int]], item: tuple[int, int]) -> None:
        at = bisect_left(ordered, item)
        if at < len(ordered) and ordered[at] == item:
            ordered.pop(at)

    out = []
    for length, source, cluster in pieces:
        s, c = bit.get(source, 0), cluster_bit.get(cluster, 0)
        own = min((lists[k] for k in ((0, source), (1, cluster)) if k in lists), key=len, default=every)
        found = -1
        for at in range(bisect_left(own, (length, -1)), len(own)):
            b = own[at][1]
            if not masks[b][-1] & s and not clusters[b] & c:
                found = b
                break
        if found < 0:
            found = len(residual)
            residual.append(capacity)
            masks.append([0] * per_source)
            clusters.append(0)
        else:
            item = (residual[found], found)
            take_out(every, item)
            for ordered in lists.values():
                take_out(ordered, item)
        residual[found] -= length
        for k in range(per_source):
            if not masks[found][k] & s:
                masks[found][k] |= s
                break
        clusters[found] |= c
        if residual[found]:
            item = (residual[found], found)
            insort(every, item)
            for key, ordered in lists.items():
                if admits(found, key):
                    insort(ordered, item)
        out.append(found)
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, cluster, n) with n words in text; a null cluster becomes a hash of the words, if there are any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = tk.utf8(b.column("text"))
            n, same = [np.empty(0, np.int64)], []
            for i, j in tk.blocks(off):
                text = tk.lowered(raw[off[i] : off[j]])
                starts, ends, first = tk.word_bounds(text, off[i : j + 1] - off[i], "space")
                flat, to = tk.joined(text, starts, ends, 1)
                at = np.r_[to, len(flat)][first]
                same += [int.from_bytes(blake2b(flat[x:y], digest_size=8).digest(), "little", signed=True) if y > x else None for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                n.append(np.diff(first))
            cluster = pc.coalesce(b.column("cluster"), pa.array(same, pa.int64()))
            yield pa.record_batch({"doc_id": b.column("doc_id"), "source": b.column("source"), "cluster": cluster, "n": pa.array(np.concatenate(n))})

    return docs.mapInArrow(count, "doc_id long, source string, cluster long, n long")


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, cluster: Column | None = None) -> DataFrame:
    """doc_id, piece, first_word, n_words, bin and bin_words (words in the bin) of every piece.

    cluster: what says that documents are duplicates of one another; where it is null or not given, equal words do.
    """
    cluster = F.lit(None).cast("long") if cluster is None else cluster.cast("long")
    rows = word_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), cluster.alias("cluster")))
    rows = staging.staged(rows, "words", max(12, staging.files_for(staging.input_bytes(docs), FILE_BYTES)))  # texts are read once
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)).cast("int"))))
    first = F.col("piece").cast("long") * capacity
    pieces = pieces.select("doc_id", "source", "cluster", "piece", first.alias("first_word"), F.least(F.col("n") - first, F.lit(capacity)).cast("long").alias("n_words"))
    total = pieces.agg(F.sum("n_words").alias("w"), F.count("*").alias("c")).first()
    shards = max(1, math.ceil((total.w or 0) / SHARD_WORDS), math.ceil(total.c / SHARD_PIECES))
    dealt = pieces.where("n_words > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by([("n_words", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("cluster", "ascending")])
        n = t["n_words"].to_numpy()
        bins = np.array(best_fit(list(zip(n.tolist(), t["source"].to_pylist(), t["cluster"].to_pylist(), strict=True)), capacity, per_source), np.int64)
        return pa.table({"doc_id": t["doc_id"], "piece": t["piece"], "first_word": t["first_word"], "n_words": t["n_words"], "bin": pa.array(bins + (t["shard"][0].as_py() << 32)), "bin_words": pa.array(np.bincount(bins, n)[bins].astype(np.int64))})

    schema = "doc_id long, piece int, first_word long, n_words long, bin long, bin_words long"
    packed = dealt.groupBy("shard").applyInArrow(fit, schema)
    empty = pieces.where("n_words <= 0").select("doc_id", "piece", "first_word", "n_words", F.lit(None).cast("long").alias("bin"), F.lit(None).cast("long").alias("bin_words"))
    return packed.unionByName(empty)
