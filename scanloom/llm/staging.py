"""Shared tables, bounded sketches and graph steps that the corpus operators build on."""

from __future__ import annotations

import gc
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A sketch of repeated hashes has at most 2**LOG_BITS bits, and so at most 16 MB; its classes take a quarter of that.
LOG_BITS = 27
#: Hashes that a task gathers before it hands them on.
FLUSH = 2 << 20
#: Bytes of a staged table that a task gathers before it writes them.
ROW_GROUP = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, one of our own if Spark is a single process, as in
    tests; on a cluster that would be a different folder on each machine, so it is an error there."""
    try:
        folder = spark.conf.get("spark.checkpoint.dir")
    except Exception:  # the key has no default in this Spark
        folder = None
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "/tmp/scanloom-checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def relieved(spark: SparkSession) -> None:
    """Gives back what the driver no longer needs. Its heap would otherwise grow to its limit over the many plans of a
    pipeline and stay there, and shuffle files and broadcasts that nothing refers to would stay with it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark.sparkContext._jvm.System.gc()


def staged(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """df, written once to the shared folder and read back: its lineage ends there and a lost executor costs nothing.

    files: most files to write, for tables that are known to be small. The table is deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scanloom/{name}-{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.options(**{"compression": "zstd", "parquet.block.size": ROW_GROUP}).parquet(path)
    fs, at = _hadoop_path(spark, path)
    fs.deleteOnExit(at)
    relieved(spark)
    return spark.read.schema(df.schema).parquet(path)


def released(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        fs, at = _hadoop_path(df.sparkSession, folder)
        fs.delete(at, True)


def files_for(rows: int, each: int) -> int:
    return max(1, -(-rows // each))


def input_bytes(df: DataFrame) -> int:
    """Spark's own estimate of the size of df, which reads no data; where it has none, the bytes of the texts."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else int(df.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def slices(df: DataFrame) -> int:
    """Into how many slices hashes of df's words are dealt: a power of two that follows the size of the input."""
    return 1 << min(14, max(4, math.ceil(math.log2(max(1, input_bytes(df) / (8 << 20))))))


def log_bits(df: DataFrame) -> int:
    return min(LOG_BITS, max(20, math.ceil(math.log2(max(2, input_bytes(df) / 2)))))


def packed(hashes: Iterator[np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    """Counts 64-bit hashes map-side and deals them by their leading bits, five bytes each.

    The last 24 bits are left out, which can only make two hashes look alike: a sketch may then call a hash repeated
    that is not, and no result depends on that.
    """
    held: list[np.ndarray] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        h = np.concatenate(held)
        h.sort()
        h, counts = _counted(h >> np.uint64(24))
        shift = np.uint64(40 - parts.bit_length() + 1)
        cuts = np.searchsorted(h >> shift, np.arange(parts + 1, dtype=np.uint64))
        single = counts == 1
        rows = [(p, _five(h[a:b][single[a:b]]), _five(h[a:b][~single[a:b]]), counts[a:b][~single[a:b]].astype(np.int64).tobytes()) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        if rows:
            part, one, more, n = zip(*rows, strict=True)
            yield pa.record_batch({"part": pa.array(part, pa.int32()), "one": pa.array(one, pa.binary()), "more": pa.array(more, pa.binary()), "n": pa.array(n, pa.binary())})

    for x in hashes:
        held.append(x)
        size += len(x)
        if size >= FLUSH:
            yield from flush()
            held, size = [], 0
    if size:
        yield from flush()


PACKED = "part int, one binary, more binary, n binary"


def _five(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _eight(blob: bytes) -> np.ndarray:
    five = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    out = np.zeros((len(five), 8), np.uint8)
    out[:, :5] = five
    return out.view("<u8").reshape(-1)


def _counted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, and how often each is there."""
    if not len(h):
        return h, np.empty(0, np.int64)
    at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return h[at], np.diff(np.r_[at, len(h)])


class Sketch:
    """Which hashes occur at least twice, and roughly how often: a bit table and a table of logarithms, both bounded.

    Both are plain functions of a hash and the same in every task, so that an order made of them is one global order.
    """

    def __init__(self, bits: bytearray, classes: bytearray, log_bits: int) -> None:
        self.bits, self.classes, self.log = np.frombuffer(bits, np.uint8), np.frombuffer(classes, np.uint8), log_bits

    def repeated(self, h: np.ndarray) -> np.ndarray:
        at = h >> np.uint64(64 - self.log)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0

    def order(self, h: np.ndarray) -> np.ndarray:
        """0 for a hash that occurs once, 1 for a few times, then the logarithm of how often, from 3."""
        return np.where(self.repeated(h), np.maximum(self.classes[h >> np.uint64(64 - self.log + 5)], 1), 0).astype(np.uint8)


def sketch(counted: DataFrame, parts: int, log: int):
    """A broadcast of (bits, classes, log) from what packed() gave; at most 2**LOG_BITS / 8 * 5 / 4 bytes."""

    def slice_of(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        one, more, n = (table[c].to_pylist() for c in ("one", "more", "n"))
        h = np.concatenate([*map(_eight, one), *map(_eight, more)])
        c = np.concatenate([np.ones(sum(map(len, one)) // 5, np.int64), *(np.frombuffer(x, np.int64) for x in n)])
        order = np.argsort(h, kind="stable")
        h, c = h[order], c[order]
        at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        h, c = h[at], np.add.reduceat(c, at)
        h, c = h[c >= 2], c[c >= 2]
        lead = np.uint64(part) << np.uint64(log - parts.bit_length() + 1)
        where = ((h >> np.uint64(40 - log)) - lead).astype(np.int64)
        bits = np.zeros(max(8, (1 << log) // parts), bool)
        bits[where] = True
        classes = np.zeros(len(bits) >> 5 or 1, np.uint8)
        often = c >= 8
        np.maximum.at(classes, where[often] >> 5, np.log2(c[often]).astype(np.uint8))
        return pa.table({"part": pa.array([part], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()]), "classes": pa.array([classes.tobytes()])})

    got = counted.groupBy("part").applyInArrow(slice_of, "part int, bits binary, classes binary").collect()
    bits, classes = bytearray((1 << log) // 8), bytearray((1 << log) // 32)
    for r in got:
        for whole, x in ((bits, r.bits), (classes, r.classes)):
            whole[r.part * len(x) : (r.part + 1) * len(x)] = x
    del got  # the driver holds the tables once
    return counted.sparkSession.sparkContext.broadcast((bits, classes, log))


def with_sketch(cast) -> Sketch:
    return Sketch(*cast.value)


#: Edges in a file of a table of edges.
EDGES = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b), a staged table: the smallest node that links reach.

    Alternating large-star and small-star steps until one changes nothing; each is two shuffles of the edges that are
    left, and each result is a table in the shared folder, with as many files as its edges need. A hub is spread by
    map-side minima and by joins that adaptive execution can split.
    """
    e = staged(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", files_for(edges.count(), EDGES))
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = staged(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges", files_for(before[0] if before else e.count(), EDGES))
        released(e)
        e = new
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def arrow_map(f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch]):
    """A mapInArrow function from one that takes a batch at a time."""

    def over(batches):
        for b in batches:
            if b.num_rows:
                out = f(b)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return over
