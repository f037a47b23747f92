"""Similarity self-join of documents on word shingles with token-combination prefixes.

A document is its set of distinct shingles, as 64-bit hashes. All hashes are counted once; a bounded sketch of the
counts puts every shingle into a class by how often it occurs, and (class, hash) is one global order, rarest first.
With a threshold t, a set of n shingles that links to another misses at most e = n - ceil(t n) of its own in the other.
Its prefix is extended in that order until it covers more than e: a rare shingle covers one; the frequent ones are
dealt into groups, and a group of f of them in the prefix covers f - 1, as it is indexed by pairs. Two linked sets
then share a single rare shingle or a pair of frequent ones of a group, in both prefixes. A set that cannot cover e is
also indexed by its plain prefix. Shingles that occur once are covered but never indexed.

The number of groups follows the size of the set, by powers of two, so that a group has a few members and the entries
of a set are in proportion to its shingles however many are frequent. Linked sets of neighbouring powers meet because
the larger one is indexed with the groups of both.

Verification is staged: one representative for each distinct set; in each index list everything is first held against
two hubs of the list; what is then in the same component needs no further comparison; all other pairs of a list are
compared inside the join that finds them. A parity bitmap of 1,024 bits bounds the symmetric difference from below and
drops most false candidates before full sets are read. Links that the second step finds join components of the first,
so only the components they touch are gone through again. No link between different sets is lost, and no list is expanded into all its pairs unless its
members are in different components.

Defined results: null and empty texts have empty sets and link with nothing; a row with a null doc_id is a component
without an id; repeated rows link by their equal sets; rows that share a doc_id are one node of the graph.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm import staging
from scanloom.llm import textkernel as tk

#: Logarithm of the count from which a shingle is frequent, and shingles of a set for each group of frequent ones.
FREQUENT, GROUP = 4, 20
BITS = 1024
B = [f"b{i}" for i in range(BITS // 64)]

#: Bytes of text whose sets are handed on together.
ROWS_BYTES = 1 << 20
#: Bytes of text for each file of sets, and distinct sets for each file of the tables that follow.
FILE_BYTES, FILE_SETS = 16 << 20, 10_000

#: own: shingles of the set that no other document has.
SETS = "doc_id long, n long, own long, key binary, sigs array<long>, " + ", ".join(f"{b} long" for b in B)


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a block."""
    starts, ends, first = tk.word_bounds(raw, off, "space")
    words = tk.span_hashes(raw, starts, ends, lower=True)
    h = tk.window_hashes(words, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            x = np.sort(h[a : b - k + 1])
            out.append(x[np.r_[True, x[1:] != x[:-1]]])
        elif b > a:
            short = words[a : a + 1].copy()
            for j in range(a + 1, b):
                short *= np.uint64(0x9FB21C651E98DF25)
                short += words[j]
            out.append(tk.mix(short + np.uint64(b - a)))
        else:
            out.append(h[:0])
    return out


def signatures(x: np.ndarray, classes: np.ndarray, percent: int) -> np.ndarray:
    """The index entries of one set (sorted hashes and their classes)."""
    n = len(x)
    least = -(-percent * n // 100)
    order = np.argsort(classes, kind="stable")
    x, classes = x[order], classes[order]
    rare = classes < FREQUENT
    plain = slice(0, n - least + 1)
    if rare[plain].all():
        return tk.mix(x[plain][classes[plain] > 0] ^ np.uint64(0x51))
    power = n.bit_length() - 1
    powers = [power, power - 1] if least < 1 << power else [power]  # a linked set may be of the power below
    return np.unique(np.concatenate([y for p in powers for y in _entries(x, classes, rare, n - least, np.uint64(max(1, (1 << p) // GROUP)))]))


def _entries(x: np.ndarray, classes: np.ndarray, rare: np.ndarray, misses: int, groups: np.uint64) -> list[np.ndarray]:
    n = len(x)
    group = x % groups
    covers = np.ones(n, np.int64)
    at = np.flatnonzero(~rare)
    covers[at[np.unique(group[at], return_index=True)[1]]] = 0
    stop = int(np.searchsorted(np.cumsum(covers), misses + 1)) + 1
    out = [tk.mix(x[:stop][rare[:stop] & (classes[:stop] > 0)] ^ np.uint64(0x51))]
    often, of = x[:stop][~rare[:stop]], group[:stop][~rare[:stop]]
    by = np.lexsort((often, of))
    often, of = often[by], of[by]
    for gap in range(1, len(often)):
        same = np.flatnonzero(of[gap:] == of[:-gap])
        if not len(same):
            break
        out.append(tk.mix(often[same] * np.uint64(0xD1342543DE82EF95) + tk.mix(often[same + gap])))
    if stop > n:
        out.append(tk.mix(x[: misses + 1][classes[: misses + 1] > 0] ^ np.uint64(0x53)))
    return out


def index(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """One row per document; documents without an index entry have only doc_id and n."""
    parts, log = staging.slices(docs), staging.log_bits(docs)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            raw, off = tk.utf8(b.column("text"))
            for i, j in tk.blocks(off):
                yield from (x for x in [np.concatenate([np.empty(0, np.uint64), *shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], k)])] if len(x))

    cast = staging.sketch(docs.mapInArrow(lambda it: staging.packed(hashes(it), parts), staging.PACKED), parts, log)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = staging.with_sketch(cast)
        for b in batches:
            raw, off = tk.utf8(b.column("text"))
            ids = b.column("doc_id")
            for i, j in tk.blocks(off, ROWS_BYTES):
                sets = shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], k)
                every = seen.order(np.concatenate(sets))
                n = np.array([len(x) for x in sets], np.int64)
                begin = np.r_[0, np.cumsum(n)]
                key, sigs, bits, own = [], [], [], []
                for d, x in enumerate(sets):
                    s = signatures(x, every[begin[d] : begin[d + 1]], percent) if len(x) and ids[i + d].is_valid else x[:0]
                    if len(s):
                        key.append(blake2b(x.tobytes(), digest_size=16).digest())
                        sigs.append(s.view(np.int64))
                        bits.append(np.packbits((np.bincount((x >> np.uint64(54)).astype(np.int64), minlength=BITS) & 1).astype(bool)).view(np.int64))
                        own.append(int(np.count_nonzero(every[begin[d] : begin[d + 1]] == 0)))
                    else:
                        bits.append(np.zeros(len(B), np.int64))
                        for column in (key, sigs, own):
                            column.append(None)
                yield pa.record_batch({"doc_id": ids.slice(i, j - i), "n": pa.array(n), "own": pa.array(own, pa.int64()), "key": pa.array(key, pa.binary()), "sigs": pa.array(sigs, pa.list_(pa.int64())), **dict(zip(B, map(pa.array, np.stack(bits, 1)), strict=True))})

    return staging.staged(docs.mapInArrow(rows, SETS), "sets", max(24, staging.files_for(staging.input_bytes(docs), FILE_BYTES)))


def _plausible(percent: int) -> Column:
    """Sizes (nx, ny) and parity bitmaps (xb*, yb*) allow a link: what the bitmaps differ in, the sets differ in."""
    least = F.expr(f"({percent} * (nx + ny) + {99 + percent}) div {100 + percent}")
    differ = sum((F.bit_count(F.col(f"x{b}").bitwiseXOR(F.col(f"y{b}"))) for b in B), F.lit(0))
    return (least <= F.least("nx", "ny")) & (differ <= F.col("nx") + F.col("ny") - 2 * least)


def _side(rows: DataFrame, s: str, *more: str) -> DataFrame:
    return rows.select(*more, F.col("key").alias(s), F.col("n").alias(f"n{s}"), *[F.col(b).alias(f"{s}{b}") for b in B])


def _links(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, percent: int, files: int) -> DataFrame:
    """(a, b): leaders of those plausible pairs (x, y) of set keys that link. Only the sets that are in a pair are read
    from their texts again."""
    pairs = staging.staged(pairs, "pairs", files)
    needed = pairs.select(F.explode(F.array("x", "y")).alias("key")).distinct().join(nodes.select("key", "lead"), "key")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = tk.utf8(b.column("text"))
            for i, j in tk.blocks(off, ROWS_BYTES):
                blobs = [x.tobytes() for x in shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], k)]
                part = b.slice(i, j - i)
                same = [blake2b(x, digest_size=16).digest() == y.as_py() for x, y in zip(blobs, part.column("key"), strict=True)]  # rows may share a doc_id
                yield pa.record_batch({"key": part.column("key"), "lead": part.column("lead"), "tokens": pa.array(blobs, pa.binary())}).filter(pa.array(same, pa.bool_()))

    full = docs.join(needed, docs["doc_id"] == needed["lead"]).select("key", "lead", "text").mapInArrow(sets, "key binary, lead long, tokens binary").dropDuplicates(["key"])
    both = pairs.join(full.toDF("x", "a", "tx"), "x").join(full.toDF("y", "b", "ty"), "y").select("a", "b", "tx", "ty")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for tx, ty in zip(b.column("tx"), b.column("ty"), strict=True):
                x, y = np.frombuffer(tx.as_buffer(), np.uint64), np.frombuffer(ty.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int(np.count_nonzero(y[at] == x))
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return staging.staged(both.mapInArrow(exact, "a long, b long"), "links", files)


def classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of each document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = index(docs, k, percent)
    indexed = rows.where("key is not null")
    lead = indexed.groupBy("key").agg(F.min("doc_id").alias("lead"))
    files = staging.files_for(rows.count(), FILE_SETS)
    nodes = staging.staged(indexed.join(lead, "key").where("doc_id = lead").select("key", "lead", "n", "own", "sigs", *B).dropDuplicates(["key"]), "nodes", files)
    files = staging.files_for(nodes.count(), FILE_SETS)
    lists = nodes.select("key", "lead", "n", "own", F.explode("sigs").alias("sig"))

    # two hubs for each list: the member with the fewest shingles of its own, which edited copies are nearest to, and a
    # member by one of four orders
    hubs = lists.groupBy("sig").agg(F.min(F.struct("own", "key", "n")).alias("u"), F.min(F.struct(F.xxhash64("key", F.pmod("sig", F.lit(4))).alias("o"), "key", "n")).alias("v"), F.count("*").alias("c")).where("c > 1")
    hub = hubs.select("sig", F.explode(F.array_distinct(F.array(F.struct("u.key", "u.n"), F.struct("v.key", "v.n")))).alias("hub"))
    near = (F.col("n") * 100 >= F.col("hub.n") * percent) & (F.col("hub.n") * 100 >= F.col("n") * percent)
    star = lists.join(hub, "sig").where((F.col("key") != F.col("hub.key")) & near)
    pairs = star.select(F.least("key", "hub.key").alias("x"), F.greatest("key", "hub.key").alias("y")).distinct()
    sides = pairs.join(_side(nodes, "x"), "x").join(_side(nodes, "y"), "y").where(_plausible(percent)).select("x", "y")
    label = staging.components(_links(sides, docs, nodes, k, percent, files))

    named = nodes.join(label, nodes["lead"] == label["node"], "left").select("key", "lead", "n", *B, "sigs", F.coalesce("component", "lead").alias("c"))
    named = staging.staged(named, "named", files)
    member = named.select("key", "c", F.explode("sigs").alias("sig"))
    mixed = member.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("sig")
    member = staging.staged(member.join(mixed, "sig", "left_semi").join(named.select("key", "n", *B), "key"), "members", files)
    x, y = _side(member, "x", "sig", F.col("c").alias("cx")), _side(member, "y", F.col("sig").alias("sig_y"), F.col("c").alias("cy"))
    cross = x.join(y, (F.col("sig") == F.col("sig_y")) & (F.col("cx") < F.col("cy")) & _plausible(percent)).select("x", "y").distinct()
    second = _links(cross, docs, nodes, k, percent, files)

    # the second step links components: theirs are the smallest of the components that a component reaches
    of = named.select("lead", "c")
    ends = second.join(of.toDF("a", "ca"), "a").join(of.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    whole = staging.components(staging.staged(ends, "ends", files)).toDF("c", "whole")
    found = named.select("key", "c").join(whole, "c", "left").select("key", F.coalesce("whole", "c").alias("c"))
    linked = indexed.select("doc_id", "n", "key").join(found, "key").select("doc_id", "n", "c")
    alone = rows.where("key is null").select("doc_id", "n", F.col("doc_id").alias("c"))
    return linked.unionByName(alone).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("c").alias("component_id"))


def representatives(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with all their columns, less those that have a smaller doc_id in their class."""
    gone = classes(docs, k, percent).where("component_id < doc_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")
