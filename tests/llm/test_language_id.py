import math
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from scanloom.llm import language_id

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = language_id.identify(docs).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d in lang if crc32(str(d).encode()) % 3 == 1}
    right = sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held)
    print("held-out accuracy", right, "mean score", sum(r.score for r in held) / len(held))
    assert right > 0.93
    assert abs(sum(r.score for r in held) / len(held) - right) < 0.08
    assert all(0 <= r.score <= 1 for r in rows)


def test_vectors_against_plain_strings():
    """n-grams of code points of the lower-cased text with single spaces for what is no letter; shares times weights."""
    texts = ["Der Hund, 12 Katzen!", "été À Ω", "x", "a\U00032000b 日本語 \U000323AF", "", "12"]
    raw, off = language_id.tk.utf8(pa.array(texts))
    bucket, doc, has = language_id.grams(raw, off)
    idf = np.linspace(1, 2, language_id.BUCKETS)
    got = language_id.vectors(bucket, doc, len(texts), idf)
    name = {}

    def of(gram: str) -> int:
        """The bucket of one n-gram, from a text that has no other of its length."""
        if gram not in name:
            h = 0
            for k, c in enumerate(gram):
                h = (h * 0x9E3779B97F4A7C15 + ord(c) + (len(gram) << 40 if not k else 0)) % 2**64
            name[gram] = h * 0xC2B2AE3D27D4EB4F % 2**64 >> 49
        return name[gram]

    for t, (at, value), letter in zip(texts, got, has, strict=True):
        plain = re.sub(r" +", " ", "".join(c.lower() if c.isalpha() else " " for c in t))
        grams = [of(plain[i : i + k]) for k in (1, 2, 3) for i in range(len(plain) - k + 1)]
        assert letter == any(c.isalpha() for c in t)
        assert dict(zip(at.tolist(), value.tolist(), strict=True)) == {b: pytest.approx(grams.count(b) / len(grams) * idf[b]) for b in set(grams)}


def test_fit_against_plain_loops():
    """Follow the regularised leader, coordinate by coordinate in plain Python, on a tiny corpus."""
    r = np.random.default_rng(4)
    x = [(np.unique(r.integers(0, 12, 5)), None) for _ in range(70)]
    x = [(a, r.random(len(a)) / 9) for a, _ in x]
    y = np.array([int(a[0] % 3) for a, _ in x])
    idf = np.ones(language_id.BUCKETS)
    m = language_id.fit(x, y, idf, ["a", "b", "c"])
    z, n = {}, {}
    alpha, beta, l1, l2 = language_id.ALPHA, language_id.BETA, language_id.L1, language_id.L2

    def weight(i, c):
        zi, ni = z.get((i, c), 0.0), n.get((i, c), 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(ni)) / alpha + l2)

    order = np.random.default_rng(11)
    train = np.array([k for k in range(len(x)) if k % 5 != 4])
    for _ in range(language_id.PASSES):
        p = order.permutation(train)
        for a in range(0, len(p), language_id.BATCH):
            g = {}
            for k in p[a : a + language_id.BATCH]:
                f = [*zip(x[k][0].tolist(), (x[k][1] * 30).tolist(), strict=True), (language_id.BUCKETS, 1.0)]
                s = [sum(v * weight(i, c) for i, v in f) for c in range(3)]
                e = [math.exp(v - max(s)) for v in s]
                for c in range(3):
                    for i, v in f:
                        g[i, c] = g.get((i, c), 0.0) + v * (e[c] / sum(e) - (c == y[k]))
            w = {key: weight(*key) for key in g}
            for key, v in g.items():
                sigma = (math.sqrt(n.get(key, 0.0) + v * v) - math.sqrt(n.get(key, 0.0))) / alpha
                z[key] = z.get(key, 0.0) + v - sigma * w[key]
                n[key] = n.get(key, 0.0) + v * v
    for i in range(12):
        for c in range(3):
            assert m.table[i, c] == pytest.approx(weight(i, c) * 30, abs=1e-9)
    assert m.bias.tolist() == pytest.approx([weight(language_id.BUCKETS, c) for c in range(3)], abs=1e-9)


def test_edges(spark):
    docs = spark.createDataFrame([(None, "the text", "en", 1), (1, None, "en", 1), (2, "123 !?", "en", 1), (3, "", None, 1), (4, "der die das und", "de", 1), (5, "the and of with", "en", 1), (5, "the and of with", "en", 1), (6, "x" * 300_000, None, 1), (9, "the of", None, 2)], "doc_id long, text string, lang string, score int")
    got = {(r.doc_id, r.lang_pred): r.score for r in language_id.identify(docs).collect()}
    assert got[(1, "und")] == got[(2, "und")] == got[(3, "und")] == 0
    assert len(got) == 8
    assert language_id.identify(docs.where("false")).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs.where("lang is null")).collect()} == {"und"}
