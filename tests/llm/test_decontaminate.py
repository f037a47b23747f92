import re
from hashlib import sha256
from random import Random

import numpy as np
import pyarrow as pa

from scanloom.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, n=10):
    windows = {}
    for i, t in items:
        w = words(t)
        if i is not None:
            for k in range(max(1, len(w) - n + 1) if w else 0):
                windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = [False] * len(w), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (x := tuple(w[k : k + size])) in windows:
                    found |= windows[x]
                    hit[k : k + size] = [True] * size
        names = ",".join(sorted(map(str, found)))
        out.append((d if d is not None else -1, len(w), sum(hit), len(found), sha256(names.encode()).hexdigest(), any(hit)))
    return sorted(out)


def case(seed):
    r = Random(seed)
    word = lambda: "".join(r.choice("abé1") for _ in range(r.randint(1, 3)))
    items = [(i, r.choice([" ", ", ", "\n"]).join(word() for _ in range(r.choice([1, 3, 9, 10, 11, 30])))) for i in range(12)] + [(100, None), (101, "!!"), (None, "a b c d e f g h i j"), (3, "twice the id"), (9, "zz")]
    docs = [(0, None), (1, ""), (2, "zz"), (2, "zz"), (None, "zz ZZ, zz"), (3, "q" * 100_000 + " zz")]
    for d in range(4, 60):
        w = [word() for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 2)):
            w += words(r.choice(items)[1])[: r.choice([9, 10, 40])]
        docs.append((d, r.choice([" ", "-", "\n"]).join(w).upper() if r.random() < 0.3 else " ".join(w)))
    return docs, items


def test_against_brute_force(spark, monkeypatch):
    for seed, block in ((1, 1 << 24), (2, 120)):  # the second in many blocks
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        docs, items = case(seed)
        d = spark.createDataFrame([(*x, 5) for x in docs], "doc_id long, text string, items int").repartition(3)
        b = spark.createDataFrame(items, "item_id long, text string")
        got = sorted((r.doc_id if r.doc_id is not None else -1, *tuple(r)[1:]) for r in decontaminate.digest(decontaminate.contamination(d, b)).collect())
        assert got == brute(docs, items)
        kept = decontaminate.clean(d, b)
        assert kept.columns == d.columns
        bad = {x[0] for x in got if x[-1]}
        assert {r.doc_id if r.doc_id is not None else -1 for r in kept.collect()} == {x[0] for x in got} - bad


def test_rows_stay_or_go_by_their_own_text(spark):
    b = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    rows = [(None, "red green blue"), (None, "a clean text"), (None, None), (7, "so red green blue"), (7, "clean as well"), (7, "clean as well")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = [r for r in rows if not (r[1] or "").endswith("blue")]
    assert sorted(map(str, (tuple(r) for r in decontaminate.clean(d, b).collect()))) == sorted(map(str, want))


def test_words_that_share_a_hash(spark, monkeypatch):
    """Terms are told by their letters: long words that a polynomial confuses, and all words if all hashes are equal."""
    a, z = ("".join(x[bin(k).count("1") % 2] for k in range(2048)) for x in ("ab", "ba"))
    d = spark.createDataFrame([(1, a), (2, z), (3, f"{z} {a}"), (4, "red blue green")], "doc_id long, text string")
    b = spark.createDataFrame([(1, a), (2, "blue green")], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate.contamination(d, b).collect()} == {1: 1, 2: 0, 3: 1, 4: 2}
    monkeypatch.setattr(decontaminate.tk, "span_hashes", lambda raw, starts, ends, lower: np.zeros(len(starts), np.uint64))
    texts = ["red blue green", "blue", "green blue green blue green", ""]
    raw, off = decontaminate.tk.utf8(pa.array(texts))
    q = decontaminate.Queries([1, 2], ["blue green", "red"], 10)
    shard = decontaminate.Shard(decontaminate.posted(raw, off), q)
    window, start = shard.phrases(q)
    assert sorted(zip(window.tolist(), start.tolist(), strict=True)) == [(0, 1), (0, 7), (0, 9), (1, 0)]


def test_proximity(spark):
    b = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    d = spark.createDataFrame([(1, "blue x red y green"), (2, "red x x x x x x x x green blue"), (3, "red green")], "doc_id long, text string")
    assert {r.doc_id: r.n_hit > 0 for r in decontaminate.contamination(d, b, slop=4).collect()} == {1: True, 2: False, 3: False}


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(d, b).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontaminate.contamination(one, b).first().n_hit == 0
