"""The corpus pipeline: each stage takes all that its predecessor kept, and its decisions take effect.

All stages but the last return the columns of documents. A stage works on whole texts of all its input; what it finds
is judged on that input, so the similarity join sees texts after line deduplication. run() writes the result of each
stage to the shared folder and reads it again for the next, as stages run one by one would.

Defined results, for every stage: an empty table gives an empty table; a column besides doc_id, text, lang and source is
carried along whatever its name, and n_chars, where there is one, is the text's length once lines are cut out; rows that
are equal are the same document and stay or go together; a null doc_id is a document of its own. Null and empty texts go
in the first stage, which finds no language in them. Texts may have any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm import decontaminate, jaccard_join, language_id, line_dedup, packing, staging


def _row(docs: DataFrame):
    """All columns as one, so that none clashes with those that an operator adds."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go; lang becomes what was recognised. Without any document to learn
    from, all stay as they are."""
    model = language_id.train(docs)
    staging.relieved(spark)
    if model is None:
        return docs
    out = language_id.predict(docs.select(_row(docs), "text"), model).where(F.col("lang_pred") != language_id.UNKNOWN)
    return out.select(F.col("row").withField("lang", F.col("lang_pred")).alias("row")).select("row.*")


def line_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that occur earlier are cut out; documents of which nothing stays go."""
    out = line_dedup.dedup(docs.select(_row(docs), "doc_id", "text")).where((F.col("n_removed_chunks") == 0) | F.col("text").rlike(r"\S"))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(row.alias("row")).select("row.*")


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays; without an id, a document stays."""
    return jaccard_join.representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word inside a benchmark window go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their bins."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identified),
    ("line_dedup", line_deduplicated),
    ("ngram_jaccard_join", near_deduplicated),
    ("benchmark_decontamination", decontaminated),
    ("best_fit_packing", packed),
]

#: Language identification, similarity classes and best fit are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = staging.staged(stage(spark, docs, sf_dir), name)
        if before is not None:
            staging.released(before)
        before = docs
    return docs
