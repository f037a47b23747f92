"""Each stage on its own input against brute force, and the whole run."""

from pyspark.sql import functions as F

import corpus_pipeline
from scanloom.llm import staging
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_jaccard_join import brute as components
from tests.llm.test_line_dedup import brute as lines
from tests.llm.test_packing import plain as tightest

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        before = {r.doc_id: r for r in docs.collect()}
        if name == "best_fit_packing":
            assert {r.doc_id for r in out.collect()} == set(before)
            rows = [(d, r.source, r.text.encode().lower().split()) for d, r in before.items()]
            pieces = sorted(((min(2048, len(w) - k), d, k // 2048, s, tuple(w)) for d, s, w in rows for k in range(0, len(w), 2048)), key=lambda x: (-x[0], x[1], x[2]))
            want = tightest([(n, s, w) for n, _, _, s, w in pieces], 2048, 2)
            got = {(r.doc_id, r.piece): r.bin for r in out.where("bin is not null").collect()}
            assert got == {(d, k): b for (_, d, k, _, _), b in zip(pieces, want, strict=True)}
            break
        assert out.columns == COLUMNS
        after = {r.doc_id: r for r in out.collect()}
        if name == "language_id":
            assert set(after) == {d for d, r in before.items() if r.text and any(c.isalpha() for c in r.text)}
        if name == "line_dedup":
            want = lines([(d, r.text) for d, r in before.items()])
            assert {d: r.text for d, r in after.items()} == {d: t for d, (t, gone) in want.items() if not gone or t.strip()}
            assert all(r.n_chars == len(r.text) for r in after.values())
        if name == "ngram_jaccard_join":
            assert set(after) == {c for _, _, c in components([(d, r.text) for d, r in before.items()])}
        if name == "benchmark_decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            bad = {x[0] for x in contaminated([(d, r.text) for d, r in before.items()], items) if x[-1]}
            assert bad and set(after) == set(before) - bad
        docs = out


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]


def test_edges(spark, tmp_path):
    """Null, empty, very long and repeated texts, null ids, a table without n_chars and columns with clashing names."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").limit(60)
    names = ["score", "row", "n_lines", "bin", "gone", "key", "h", "words", "__i"]
    plain = docs.drop("n_chars").withColumns({n: F.lit(f"own {n}") for n in names})
    base = plain.orderBy("doc_id").first().asDict()
    odd = [base | {"doc_id": None}, base | {"doc_id": None}, base | {"doc_id": 10**9}, base | {"doc_id": 10**9}, base | {"doc_id": 5, "text": None}, base | {"doc_id": 6, "text": ""}, base | {"doc_id": 7, "lang": None, "text": "w " * 150_000}, base | {"doc_id": 8, "source": None}]
    rows = plain.unionByName(spark.createDataFrame([tuple(x[c] for c in plain.columns) for x in odd], plain.schema))
    for d in (rows, rows.where("false"), docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, d, SF)
            where = str(tmp_path / f"{name}{d.count()}{len(d.columns)}")
            out.write.parquet(where)
            out = spark.read.parquet(where)
            if name != "best_fit_packing":
                assert out.columns == d.columns
                assert all(r[n] == f"own {n}" for r in out.collect() for n in names if n in d.columns)
            if name == "language_id":
                assert out.where("text is null or text = ''").isEmpty()
            d = out


def collections(spark) -> int:
    return sum(b.getCollectionCount() for b in spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName())


def test_staged_tables_relieve_the_driver(spark):
    before = collections(spark)
    assert staging.staged(spark.range(10), "ten", 1).count() == 10
    assert collections(spark) > before
