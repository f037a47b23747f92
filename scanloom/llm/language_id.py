"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of 1 to 3 code points of the lower-cased text, in which every run of other characters than
letters is one space. A feature's value is its share of the text's n-grams times its inverse document frequency, which
is counted over all learnable documents. Training is follow-the-regularised-leader (FTRL-proximal) with elastic-net
penalties on a bounded sample of learnable documents; on documents of the sample that training leaves out, one
temperature is fitted that calibrates the probabilities. Prediction is one pass over whole texts.

Learnable: crc32 of the doc_id's digits modulo 3 is not 1, the language is not null, the text has a letter. Neither
language nor source nor doc_id are inputs of a prediction.

Defined results: `und` with score 0 for a null text or one without a letter, and for every text if nothing is
learnable; a null doc_id is not learnable and not held out; repeated rows are predicted alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm import textkernel as tk

ORDERS, BUCKETS = (1, 2, 3), 1 << 15
#: At most so many learnable documents are fitted on, whole: those whose ids have the smallest hashes.
SAMPLE = 6000
UNKNOWN = "und"
#: Fixed values of the learner: step, its offset, L1 and L2 penalty, passes, documents in a batch.
ALPHA, BETA, L1, L2, PASSES, BATCH = 2.0, 1.0, 1e-5, 1e-4, 6, 64

#: For each code point that was seen its lower case if it is a letter, else a space; 0 for those not seen yet.
_fold = np.zeros(0x110000, np.uint32)


def folded(points: np.ndarray) -> np.ndarray:
    """Letters in lower case, and a space for every other code point."""
    out = _fold[points]
    if (out == 0).any():
        for c in np.unique(points[out == 0]).tolist():
            x = chr(c)
            low = x.lower()
            _fold[c] = (ord(low) if len(low) == 1 else c) if x.isalpha() else 32
        out = _fold[points]
    return out


def grams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, document) of every n-gram of a block, and which documents have a letter."""
    text = raw.tobytes()
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts = np.cumsum(np.r_[0, (raw & 0xC0) != 0x80])[off]  # of documents, in code points
    c = folded(points)
    doc = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(starts))
    letter = c != 32
    has = np.bincount(doc[letter], minlength=len(off) - 1) > 0
    keep = letter | np.r_[True, letter[:-1]] | np.r_[True, doc[1:] != doc[:-1]] if len(c) else letter
    c, doc = c[keep].astype(np.uint64), doc[keep]
    bucket, of = [], []
    for k in ORDERS:
        if len(c) < k:
            continue
        h = c[: len(c) - k + 1] + np.uint64(k << 40)
        for j in range(1, k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + c[j : len(c) - k + 1 + j]
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        ok = doc[: len(c) - k + 1] == doc[k - 1 :]
        bucket.append((h >> np.uint64(64 - 15))[ok].astype(np.int32))
        of.append(doc[: len(c) - k + 1][ok])
    return (np.concatenate(bucket), np.concatenate(of), has) if bucket else (np.empty(0, np.int32), np.empty(0, np.int32), has)


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the learnable documents each bucket occurs, and how many there are; one array per task is merged."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            raw, off = tk.utf8(b.column("text"))
            for i, j in tk.blocks(off, 1 << 20):
                for a in range(i, j, 256):
                    z = min(j, a + 256)
                    bucket, doc, has = grams(raw[off[a] : off[z]], off[a : z + 1] - off[a])
                    there = np.zeros((z - a, BUCKETS), bool)
                    there[doc, bucket] = True
                    df += there.sum(axis=0)
                    n += int(has.sum())
        yield pa.record_batch({"k": pa.array([0]), "df": pa.array([df.tobytes()]), "n": pa.array([n])})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for x, k in zip(b.column("df").to_pylist(), b.column("n").to_pylist(), strict=True):
                df += np.frombuffer(x, np.int64)
                n += k
        yield pa.record_batch({"df": pa.array([df.tobytes()]), "n": pa.array([n])})

    parts = docs.select("text").mapInArrow(count, "k long, df binary, n long").select("df", "n").repartition(8).mapInArrow(merge, "df binary, n long")
    rows = parts.collect()  # at most 8 rows of BUCKETS numbers
    return sum((np.frombuffer(r.df, np.int64) for r in rows), np.zeros(BUCKETS, np.int64)), sum(r.n for r in rows)


def vectors(bucket: np.ndarray, doc: np.ndarray, n: int, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse TF-IDF vectors of a block's documents."""
    order = np.lexsort((bucket, doc))
    b, d = bucket[order], doc[order]
    new = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (d[1:] != d[:-1])]) if len(b) else np.empty(0, np.int64)
    count = np.diff(np.r_[new, len(b)])
    b, d = b[new], d[new]
    size = np.bincount(doc, minlength=n)
    value = count / size[d] * idf[b]
    cut = np.searchsorted(d, np.arange(n + 1))
    return [(b[x:y], value[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]


class Model:
    def __init__(self, names: list[str], table: np.ndarray, bias: np.ndarray, temperature: float) -> None:
        self.names, self.table, self.bias, self.temperature = names, table, bias, temperature

    def scores(self, bucket: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        size = np.maximum(np.bincount(doc, minlength=n), 1)
        z = np.stack([np.bincount(doc, self.table[bucket, k], n) for k in range(len(self.names))], 1) / size[:, None] + self.bias
        z = z / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def fit(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, idf: np.ndarray, names: list[str]) -> Model:
    """FTRL-proximal with elastic net, then the temperature of least log-loss on each fifth document, not trained on."""
    m = len(names)
    z, n = np.zeros((BUCKETS + 1, m)), np.zeros((BUCKETS + 1, m))
    weights = lambda zi, ni: np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
    held = np.arange(len(x)) % 5 == 4 if len(x) >= 20 else np.zeros(len(x), bool)
    scale = 30.0  # a TF-IDF value is a share; this brings inner products to the order of one
    train, rng = np.flatnonzero(~held), np.random.default_rng(11)
    for _ in range(PASSES):
        order = rng.permutation(train)
        for a in range(0, len(order), BATCH):
            ks = order[a : a + BATCH]
            rows = np.concatenate([np.r_[x[k][0], BUCKETS] for k in ks])
            values = np.concatenate([np.r_[x[k][1] * scale, 1.0] for k in ks])
            of = np.repeat(np.arange(len(ks)), [len(x[k][0]) + 1 for k in ks])
            active, at = np.unique(rows, return_inverse=True)
            w = weights(z[active], n[active])
            s = np.stack([np.bincount(of, w[at, c] * values, len(ks)) for c in range(m)], 1)
            p = np.exp(s - s.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(ks)), y[ks]] -= 1
            g = np.stack([np.bincount(at, values * p[of, c], len(active)) for c in range(m)], 1)
            sigma = (np.sqrt(n[active] + g * g) - np.sqrt(n[active])) / ALPHA
            z[active] += g - sigma * w
            n[active] += g * g
    w = weights(z, n)
    table, bias = w[:BUCKETS] * idf[:, None] * scale, w[BUCKETS]
    model = Model(names, table, bias, 1.0)
    if held.any():
        s = np.stack([w[x[k][0]].T @ (x[k][1] * scale) + bias for k in np.flatnonzero(held)])

        def loss(t: float) -> float:
            q = s / t
            q -= q.max(axis=1, keepdims=True)
            return float((np.log(np.exp(q).sum(axis=1)) - q[np.arange(len(q)), y[held]]).mean())

        model.temperature = min(np.geomspace(0.05, 20, 121), key=loss)
    return model


def _remainder():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    learnable = docs.where("lang is not null and text is not null and doc_id is not null").where(_remainder() != 1).select("doc_id", "text", "lang")
    df, n = frequencies(learnable)
    idf = np.log((1 + n) / (1 + df)) + 1
    # the ids alone say which documents are chosen; then whole texts of a bounded number, whose sparse vectors reach the driver
    rank = F.xxhash64("doc_id")
    last = learnable.select(rank.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if last is None:
        return None
    # equal rows teach once; the chosen are dealt out again, as a task alone would read them all
    chosen = learnable.where(rank <= last).distinct().orderBy(rank, "doc_id", "text", "lang").limit(sample).repartition(16)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = tk.utf8(b.column("text"))
            for i, j in tk.blocks(off):
                bucket, doc, has = grams(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                v = vectors(bucket, doc, j - i, idf)
                yield pa.record_batch({"lang": b.column("lang").slice(i, j - i), "at": pa.array([x.astype(np.int32).tobytes() for x, _ in v], pa.binary()), "value": pa.array([x.astype(np.float32).tobytes() for _, x in v], pa.binary()), "has": pa.array(has)})

    rows = chosen.mapInArrow(sparse, "lang string, at binary, value binary, has boolean").where("has").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.at, r.value, r.lang))  # the same model whatever order rows come in
    names = sorted({r.lang for r in rows})
    y = np.array([names.index(r.lang) for r in rows])
    return fit([(np.frombuffer(r.at, np.int32), np.frombuffer(r.value, np.float32)) for r in rows], y, idf, names)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred and score (columns of these names are replaced)."""
    docs = docs.drop("lang_pred", "score")
    cast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = cast.value
        for b in batches:
            raw, off = tk.utf8(b.column("text"))
            names, scores = [], []
            for i, j in tk.blocks(off):
                bucket, doc, has = grams(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                if m is None:
                    has[:] = False
                else:
                    p = m.scores(bucket, doc, j - i)
                    best = p.argmax(axis=1)
                names += [m.names[best[k]] if has[k] else UNKNOWN for k in range(j - i)]
                scores += [float(p[k, best[k]]) if has[k] else 0.0 for k in range(j - i)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    return docs.mapInArrow(run, StructType(list(docs.schema.fields)).add("lang_pred", StringType()).add("score", DoubleType()))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    out = predict(rows.select("doc_id", "text"), train(rows, sample))
    return out.select("doc_id", F.coalesce(_remainder() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
