"""Tracking of clusters over frames: a constant-velocity Kalman filter for each object, one state for each sequence.

Frames are ordered by number; a sequence is the key, so sequences run in parallel. A table is dealt by sequence and
sorted by frame, and goes through a task batch by batch: what a task holds is the living objects and one frame. All
objects of a frame are predicted, gated and updated together. The same step serves a stream (state kept by Spark,
evicted by a timeout).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frames without a match after which an object is dropped.
MISSED = 4

#: Fields of the living objects of a sequence: x, z and their velocities; covariances; size; frames without a match; name.
FIELDS = {"state": (float, (4,)), "cov": (float, (4, 4)), "size": (float, ()), "missed": (np.int64, ()), "number": (np.int64, ())}


class Sequence:
    """The living objects of a sequence, as arrays with a row for each."""

    def __init__(self, next: int = 0, frame: int = -1, **fields) -> None:
        self.next, self.frame = next, frame
        for name, (kind, shape) in FIELDS.items():
            setattr(self, name, np.array(fields.get(name, ()), kind).reshape(-1, *shape))

    @classmethod
    def load(cls, text: str) -> Sequence:
        return cls(**json.loads(text))

    def dump(self) -> str:
        return json.dumps({"next": self.next, "frame": self.frame, **{f: getattr(self, f).tolist() for f in FIELDS}})


def predict(seq: Sequence, dt: float, noise: float) -> tuple[np.ndarray, np.ndarray]:
    a = np.eye(4)
    a[0, 2] = a[1, 3] = dt
    return seq.state @ a.T, a @ seq.cov @ a.T + noise * np.diag([dt**4 / 4, dt**4 / 4, dt**2, dt**2])


def matched(score: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, column) by score, smallest first, each row and column once; ties go to the smaller name, then column."""
    i, j = np.nonzero(np.isfinite(score))
    order = np.lexsort((j, number[i], score[i, j]))
    free_i, free_j = np.ones(score.shape[0], bool), np.ones(score.shape[1], bool)
    out = []
    for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
        if free_i[a] and free_j[b]:
            free_i[a] = free_j[b] = False
            out.append((a, b))
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def step(seq: Sequence, frame: int, cluster: np.ndarray, seen: np.ndarray, size: np.ndarray, gate: float = 3.0, noise: float = 1.0, error: float = 0.25) -> dict[str, np.ndarray]:
    """One frame of clusters (by name: positions x, z and sizes): the columns of every living object afterwards.

    Pairs inside the gate (half as wide again for objects that were missed) are taken by score, nearest first; the score
    adds a part for a change of size.
    """
    dt = 1.0 if seq.frame < 0 else float(max(1, frame - seq.frame))  # frames that were never seen count as misses
    x, p = predict(seq, dt, noise)
    m = len(cluster)
    found = np.full(len(x), -1)
    fresh = np.ones(m, bool)
    if len(x) and m:
        s = p[:, :2, :2] + error * np.eye(2)
        inverse = np.linalg.inv(s)
        d = seen[None, :, :] - x[:, None, :2]
        far = np.sqrt(np.einsum("nmi,nij,nmj->nm", d, inverse, d))
        change = np.abs(size[None, :] - seq.size[:, None]) / np.maximum(np.maximum(size[None, :], seq.size[:, None]), 1e-9)
        inside = far < gate * np.where(seq.missed > 0, 1.5, 1.0)[:, None]
        i, j = matched(np.where(inside, far + 0.8 * change, np.inf), seq.number)
        found[i], fresh[j] = j, False
        k = p[i][:, :, :2] @ inverse[i]
        x[i] += np.einsum("nij,nj->ni", k, seen[j] - x[i, :2])
        p[i] -= k @ p[i][:, :2, :]
        seq.size[i] = 0.5 * (seq.size[i] + size[j])
    seq.missed = np.where(found >= 0, 0, seq.missed + int(dt))
    alive = seq.missed < MISSED
    n_new = int(fresh.sum())
    new = np.zeros((n_new, 4))
    new[:, :2] = seen[fresh]
    name = np.where(found >= 0, cluster[found] if m else -1, -1)
    seq.state, seq.cov = np.concatenate([x[alive], new]), np.concatenate([p[alive], np.repeat(np.diag([error, error, 10.0, 10.0])[None], n_new, 0)])
    seq.size, seq.missed = np.r_[seq.size[alive], size[fresh]], np.r_[seq.missed[alive], np.zeros(n_new, np.int64)]
    seq.number = np.r_[seq.number[alive], seq.next + np.arange(n_new)]
    seq.next, seq.frame = seq.next + n_new, frame
    return {"track": seq.number, "cluster": np.r_[name[alive], cluster[fresh]], "known": np.r_[found[alive] >= 0, np.ones(n_new, bool)], "state": seq.state, "missed": seq.missed}


OUT = "sequence long, frame long, track long, cluster long, x double, z double, vx double, vz double, missed int"


def _batch(rows: list[tuple[int, int, dict[str, np.ndarray]]]) -> pa.RecordBatch:
    """Steps (sequence, frame, columns) as rows."""
    n = [len(x["track"]) for _, _, x in rows]
    every = lambda f: np.concatenate([x[f] for _, _, x in rows])
    state = every("state")
    out = {"sequence": np.repeat([s for s, _, _ in rows], n), "frame": np.repeat([f for _, f, _ in rows], n), "track": every("track")}
    columns = {k: pa.array(v.astype(np.int64)) for k, v in out.items()}
    columns["cluster"] = pa.array(every("cluster").astype(np.int64), mask=~every("known"))
    columns |= {c: pa.array(state[:, k]) for k, c in enumerate(("x", "z", "vx", "vz"))}
    return pa.record_batch(columns | {"missed": pa.array(every("missed").astype(np.int32))})


def _frames(sequence: np.ndarray, frame: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.r_[True, (sequence[1:] != sequence[:-1]) | (frame[1:] != frame[:-1]), True])
    yield from zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


COLUMNS = ("sequence", "frame", "cluster", "x", "z", "size")


def track(clusters: DataFrame, **options) -> DataFrame:
    """Tracks of a table of clusters (sequence, frame, cluster, x, z, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, seq = None, Sequence()
        held: list[np.ndarray] | None = None

        def over(rows: list[np.ndarray]) -> pa.RecordBatch | None:
            nonlocal here, seq
            done = []
            for a, b in _frames(rows[0], rows[1]):
                if rows[0][a] != here:
                    here, seq = rows[0][a], Sequence()
                done.append((int(here), int(rows[1][a]), step(seq, int(rows[1][a]), rows[2][a:b], np.stack([rows[3][a:b], rows[4][a:b]], 1), rows[5][a:b], **options)))
            return _batch(done) if done else None

        for b in batches:
            new = [b.column(c).to_numpy(zero_copy_only=False) for c in COLUMNS]
            rows = new if held is None else [np.r_[x, y] for x, y in zip(held, new, strict=True)]
            last = list(_frames(rows[0], rows[1]))[-1][0] if len(rows[0]) else 0  # the last frame may go on in the next batch
            held = [x[last:] for x in rows]
            if last:
                yield over([x[:last] for x in rows])
        if held is not None and len(held[0]):
            yield over(held)

    rows = clusters.select(*[F.col(c).cast("long").alias(c) for c in COLUMNS[:3]], *[F.col(c).cast("double").alias(c) for c in COLUMNS[3:]])
    return rows.repartition("sequence").sortWithinPartitions(*COLUMNS[:3]).mapInArrow(run, OUT)


def track_stream(clusters: DataFrame, idle_ms: int = 600_000, **options) -> DataFrame:
    """The same over a stream; a micro-batch holds whole frames. A sequence that is idle for so long is forgotten."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seq = Sequence.load(state.get[0]) if state.exists else Sequence()
        pdf = pd.concat(list(batches)).sort_values(["frame", "cluster"])
        frame = pdf["frame"].to_numpy()
        cluster, seen, size = pdf["cluster"].to_numpy(np.int64), pdf[["x", "z"]].to_numpy(float), pdf["size"].to_numpy(float)
        late = seq.frame  # late frames of a sequence are not replayed
        done = [(int(key[0]), int(frame[a]), step(seq, int(frame[a]), cluster[a:b], seen[a:b], size[a:b], **options)) for a, b in _frames(np.zeros(len(frame)), frame) if frame[a] > late]
        state.update((seq.dump(),))
        state.setTimeoutDuration(idle_ms)
        if done:
            yield _batch(done).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)

    return clusters.groupBy(F.col("sequence").cast("long").alias("sequence")).applyInPandasWithState(run, OUT, "state string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_occupancy(points: DataFrame, edge: float, width: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Hits of ground cells by event-time window of a point stream (ts, x, z); rows later than `late` are dropped."""
    cell = [(F.col(c) / edge).cast("long").alias(f"c{c}") for c in "xz"]
    return points.withWatermark("ts", late).groupBy(F.window("ts", width), *cell).agg(F.count("*").alias("hits")).select(F.col("window.start").alias("start"), "cx", "cz", "hits")
