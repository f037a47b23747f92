from hashlib import md5
from random import Random

from scanloom.llm import line_dedup


def cut(text):
    lines = text.split("\n") if text else []
    h = [int(md5(x.encode()).hexdigest()[:7], 16) for x in lines]
    out, cur = [], []
    for i, x in enumerate(lines):
        cur.append(x)
        r = (h[i - 1] if i else 0) * 1009 + h[i]
        if i == len(lines) - 1 or r % 8191 % 2 == 0:
            out.append("\n".join(cur))
            cur = []
    return out


def brute(rows):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        keep, gone = [], 0
        for c in cut(t or ""):
            if "\n" in c and c.strip() and c in seen:
                gone += 1
            else:
                keep.append(c)
            seen.add(c)
        out[d] = (t if not gone else "\n".join(keep), gone)
    return out


def test_against_brute_force(spark):
    r = Random(9)
    pool = [f"line {k} é" for k in range(30)] + ["", " ", "\t"]
    block = [f"shared {k}" for k in range(12)]
    rows = [(None, "\n".join(block)), (0, None), (1, ""), (2, "\n\n\n"), (3, "\n\n\n"), (4, "x" * 50000)]
    for d in range(5, 60):
        lines = [r.choice(pool) for _ in range(r.randint(0, 12))]
        if r.random() < 0.6:
            at = r.randint(0, len(lines))
            lines[at:at] = block[r.randint(0, 4) :]
        rows.append((d, "\n".join(lines)))
    df = spark.createDataFrame([(d, t, 7, "k") for d, t in rows], "doc_id long, text string, n_lines int, gone string").repartition(4)
    out = line_dedup.dedup(df.drop("n_lines"))
    got = {x.doc_id: (x.text, x.n_removed_chunks) for x in out.collect()}
    assert got == brute(rows)
    assert sum(x[1] for x in got.values()) > 20
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_short_passages(spark):
    """Passages of 3 to 8 lines in documents that share nothing else: a good part of their repeated lines goes, and
    lines that do not repeat stay."""
    r = Random(2)
    rows, own, passages = [], {}, [[f"passage {p} line {k}" for k in range(3 + p % 6)] for p in range(60)]
    for d in range(240):
        lines = [f"document {d} line {k}" for k in range(r.randint(2, 9))]
        at = r.randint(0, len(lines))
        rows.append((d, "\n".join(lines[:at] + passages[d % 60] + lines[at:])))
        own[d] = lines
    out = {x.doc_id: x for x in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(set(own[d]) <= set(out[d].text.split("\n")) for d in own)
    repeated = sum(len(passages[d % 60]) for d in range(60, 240))
    gone = sum(out[d].n_removed_lines for d in own)
    print("share of repeated passage lines removed", gone / repeated)
    assert gone > 0.3 * repeated and all(out[d].n_removed_lines == 0 for d in range(60))


def test_chunks_that_share_a_hash(spark, monkeypatch):
    """With one hash for all chunks the bytes alone decide."""
    texts = ["\n".join(f"{c} {k}" for k in range(30)) for c in "ab"]
    df = spark.createDataFrame([(1, texts[0]), (2, texts[1]), (3, texts[0]), (4, texts[1]), (None, texts[1]), (-(1 << 63), texts[0])], "doc_id long, text string")
    want = sorted(map(str, line_dedup.dedup(df).collect()))
    real = line_dedup.F.xxhash64
    monkeypatch.setattr(line_dedup.F, "xxhash64", lambda c: line_dedup.F.lit(7).cast("long") if c == "chunk" else real(c))
    assert sorted(map(str, line_dedup.dedup(df).collect())) == want
    got = {x.doc_id: x.n_removed_chunks > 0 for x in line_dedup.dedup(df).collect()}
    assert got == {None: False, -(1 << 63): False, 1: True, 2: True, 3: True, 4: True}


def test_repeated_rows_and_empty(spark):
    text = "\n".join(f"a line {k}" for k in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed_chunks > 0) for r in line_dedup.dedup(df).collect())
    assert got == [(1, False), (1, False), (2, True)]
    assert line_dedup.dedup(df.where("false")).count() == 0
