"""Corpus pipeline: documents to a mixed, deduplicated and decontaminated corpus, a table written after each stage.

All stages but the last return the columns of documents; n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylog.llm import decontaminate, jaccard, language, mixing, substring
from quarrylog.llm._ops import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near copies: words of a shingle, and the similarity in percent from which two documents link.
SHINGLE, SIMILAR = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language the models accept; text without letters, or like no language, goes."""
    sample = language.training_sample(docs, "doc_id", "text", "lang")
    model = language.fit([t for t, _ in sample], [y for _, y in sample])
    found = docs.select(*COLUMNS).withColumn("found", language.identified(spark, model, F.col("text")))
    return found.filter(~F.col("found.rejected")).select(*COLUMNS)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of linked ones: that of the least id, rows without id last, then of the least text digest.

    Rows are told apart by id and text digest, so two texts under one id are two documents.
    """
    docs = docs.withColumn("row", F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("digest")))
    found = materialise(jaccard.join(docs, key="row", k=SHINGLE, num=SIMILAR, den=100))
    gone = materialise(found.filter("row <> component_id").select("row").distinct())
    if found.filter("row = component_id").groupBy("row").count().filter("count > 1").limit(1).count():
        docs = docs.dropDuplicates(["doc_id", "text"])  # repeated rows
    gone = F.broadcast(gone) if gone.count() <= jaccard.BROADCAST_ROWS else gone
    return docs.join(gone, "row", "left_anti").select(*COLUMNS)


def dedup_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out of all documents but the first that has them; what is left without words goes."""
    found = substring.dedup(docs, line_words=substring.LINE_WORDS, carry=("lang", "source"))
    left = found.filter((F.col("n_removed") == 0) | F.col("text").rlike("[^\\s]"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the words inside benchmark windows out of the texts; what is left without words goes."""
    found = decontaminate.hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=COLUMNS[1:])
    return decontaminate.cut_spans(found).filter("not cut or n_words > n_hit").withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the copies the mix takes of each; those it takes none of go."""
    mixed = mixing.mix(docs, carry=("text", "lang", "n_chars"))
    return mixed.filter("copies > 0").select(*COLUMNS, "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("language_id", identify_language),
    ("near_copies", join_near_copies),
    ("passages", dedup_passages),
    ("decontaminate", remove_benchmarks),
    ("mix", mix_sources),
]

#: Fitted language models and cut texts are not for SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
