"""Line deduplication on content-defined chunks of lines, in DataFrame functions only.

A line ends a chunk when a rolling hash over its own hash and that of the line before it in the document falls
into one of EVERY residues. Boundaries depend on near lines only, so that lines put in or left out somewhere shift no
boundary further down; with the short window, a passage of a few lines has boundaries of its own. Chunks of several
lines are grouped by their hash and their bytes. A hash that stands for one content is a name for it; chunks whose hash
stands for more are named by hash and bytes. Of each repeated chunk the first occurrence (the smallest doc_id, then the
first in the document) stays; all later ones are removed. Chunks of one line, and chunks without a visible character,
are never removed.

A chunk that very many documents share meets as partial aggregates; its occurrences are joined to one row by its hash,
a join that adaptive execution can split. Text is shuffled twice: once as chunks, once as documents.

Defined results: a null or empty text has no lines; rows that share doc_id and text are the same document; a null
doc_id comes before all others; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm import staging

#: One line in so many ends a chunk.
EVERY = 2
#: The rolling hash's factor, and the prime before the residue.
FACTOR, PRIME = 1009, 8191


def _hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def chunks(text: Column) -> Column:
    """array<string>: the chunks of a text; joined by newlines they are the text."""
    lines = F.split(text, "\n")

    def cut(pair: Column) -> Column:
        lines, h = pair["lines"], pair["h"]
        last = F.size(lines) - 1
        before = lambda i, k: F.when(i >= k, F.get(h, i - k)).otherwise(F.lit(0).cast("long"))
        ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (F.pmod(F.pmod(before(i, 1) * FACTOR + F.get(h, i), F.lit(PRIME)), F.lit(EVERY)) == 0))
        return F.transform(F.array(F.struct(lines.alias("lines"), ends.alias("ends"))), lambda x: F.transform(x["ends"], lambda e, k: F.array_join(F.slice(x["lines"], F.when(k == 0, F.lit(0)).otherwise(F.get(x["ends"], k - 1) + 1) + 1, e - F.when(k == 0, F.lit(-1)).otherwise(F.get(x["ends"], k - 1))), "\n")))[0]

    hashed = F.transform(F.array(lines), lambda x: F.struct(x.alias("lines"), F.transform(x, _hash).alias("h")))
    return F.when(F.length(text) > 0, F.transform(hashed, cut)[0]).otherwise(F.array().cast("array<string>"))


def _n_lines(chunk: Column) -> Column:
    return F.length(chunk) - F.length(F.replace(chunk, F.lit("\n"), F.lit(""))) + 1


def dedup(docs: DataFrame) -> DataFrame:
    """The documents with all their columns, text replaced by what stays, and n_lines, n_removed_lines, n_removed_chunks
    (any columns of these names are replaced)."""
    docs = docs.drop("n_lines", "n_removed_lines", "n_removed_chunks")
    # a null id is not the id that stands for it
    d, t, null = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), F.xxhash64("text"), F.col("doc_id").isNotNull()
    keyed = docs.select(null.alias("i"), d.alias("d"), t.alias("t"), chunks(F.col("text").cast("string")).alias("c"))
    every = keyed.select("i", "d", "t", F.posexplode("c").alias("k", "chunk")).where(F.col("chunk").contains("\n") & F.col("chunk").rlike(r"\S")).withColumn("h", F.xxhash64("chunk"))
    where = F.struct("i", "d", "t", "k")
    contents = every.groupBy("h", "chunk").agg(F.count("*").alias("n"), F.min(where).alias("lead"))
    again = staging.staged(contents.groupBy("h").agg(F.count("*").alias("contents"), F.max("n").alias("n"), F.min("lead").alias("lead")).where("contents > 1 or n > 1").select("h", "contents", "lead"), "chunks")
    # rows that share doc_id and text are one document: its own first chunk is the leader in each of them
    names = ["i", "d", "t", "k"]
    later = every.join(again.where("contents = 1"), "h").where(where != F.col("lead")).select(names)
    shared = again.where("contents > 1").select("h")
    if not shared.isEmpty():  # different chunks with one hash
        some = every.join(shared, "h", "left_semi")
        first = some.groupBy("h", "chunk").agg(F.min(where).alias("lead"))
        later = later.unionByName(some.join(first, ["h", "chunk"]).where(where != F.col("lead")).select(names))
    gone = later.select(F.col("i").alias("__gi"), F.col("d").alias("__gd"), F.col("t").alias("__gt"), "k").groupBy("__gi", "__gd", "__gt").agg(F.collect_set("k").alias("__gone"))
    left = docs.withColumns({"__i": null, "__d": d, "__t": t})
    both = left.join(gone, (F.col("__i") == F.col("__gi")) & (F.col("__d") == F.col("__gd")) & (F.col("__t") == F.col("__gt")), "left")
    parts = F.transform(chunks(F.col("text").cast("string")), lambda c, k: F.struct(c.alias("c"), F.coalesce(F.array_contains(F.col("__gone"), k), F.lit(False)).alias("out")))
    both = both.withColumn("__p", F.when(F.col("__gone").isNotNull(), parts))
    kept = F.array_join(F.transform(F.filter("__p", lambda x: ~x["out"]), lambda x: x["c"]), "\n")
    n_gone = F.aggregate(F.filter("__p", lambda x: x["out"]), F.lit(0), lambda a, x: a + _n_lines(x["c"]))
    lines = F.when(F.length("text") > 0, _n_lines(F.col("text"))).otherwise(0)
    both = both.withColumns({"n_lines": lines.cast("long"), "n_removed_lines": F.coalesce(n_gone, F.lit(0)).cast("long"), "n_removed_chunks": F.coalesce(F.size("__gone"), F.lit(0)).cast("long"), "text": F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept)})
    return both.drop("__p", "__gone", "__i", "__d", "__t", "__gi", "__gd", "__gt")


SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
  FROM documents WHERE length(text) > 0
), h AS (
  SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM l
), c AS (
  SELECT *, ((coalesce(lag(h) OVER w, 0) * 1009 + h) % 8191) % 2 = 0 AS cut FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), g AS (
  SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM c
), k AS (
  SELECT doc_id, k, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM g GROUP BY doc_id, k
), m AS (
  SELECT *, n > 1 AND regexp_matches(chunk, '[^ \\t\\n\\x0B\\f\\r]') AND row_number() OVER (PARTITION BY chunk ORDER BY doc_id, k) > 1 AS gone FROM k
), d AS (
  SELECT doc_id, sum(n) AS n_lines, coalesce(sum(n) FILTER (WHERE gone), 0) AS n_removed_lines, count(*) FILTER (WHERE gone) AS n_removed_chunks,
    coalesce(string_agg(chunk, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY doc_id
)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed_lines, 0)::BIGINT AS n_removed_lines,
  coalesce(n_removed_chunks, 0)::BIGINT AS n_removed_chunks, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN d USING (doc_id)
"""
