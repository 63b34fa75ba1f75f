"""The corpus pipeline: documents to a training mix, in stages that are each written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlode.llm import decontaminate, mixing, nearcopies, pii, quality
from runlode.llm.common import checkpointed, remainder, shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents at or above this score for label 1 are kept; it is the threshold of the quality query.
KEEP_SCORE = 0.3


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good stay."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), remainder(F.col("_id"), 5) != 0)
    scored = quality.score(docs, model, keep=("text", "lang", "source", "n_chars"))
    return scored.where(F.col("score") >= KEEP_SCORE).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8 or more) stays, the one with the least doc_id.

    SimHash finds copies, the similarity confirms them, and an exact search finds those that SimHash misses.
    """
    return nearcopies.deduplicate(docs).select(*COLUMNS)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), keep=("text", "lang", "source", "n_chars"))
    return found.where(F.size("spans") == 0).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind in brackets; all documents stay."""
    found = checkpointed(pii.candidates(docs, keep=("text", "lang", "source")))
    named = pii.label(found, pii.fit(found))
    clean = named.withColumn("text", pii.redact(F.col("text"), F.col("spans")))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def training_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the words the mix takes of each and the positions of all rounds, in their order.

    A row is a document; mixing.in_training_order makes of the rows the whole line of training. A
    document of which nothing is taken has taken 0 and no position, and comes last. Rows met here are
    distinct by doc_id and text, so both find the text again.
    """
    keyed = docs.withColumn("h", F.xxhash64("text"))
    mixed = mixing.mix(keyed, keep=("lang", "n_chars", "h"))
    texts = keyed.select(F.col("doc_id").alias("d"), F.col("h").alias("th"), "text")
    joined = mixed.join(texts, mixed["doc_id"].eqNullSafe(texts["d"]) & (mixed["h"] == texts["th"]))
    ordered = joined.select("doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "taken", "position", "positions")
    return ordered.orderBy(F.col("position").asc_nulls_last(), "positions", "doc_id")


STAGES = [
    ("quality_classifier", quality_filter),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_filter),
    ("pii", personal_data),
    ("mixing", training_mix),
]
#: Fingerprints, classifiers and learned spans have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read by the next.

    The folder is the one that checkpoints go to. What a stage wrote is deleted when the next has
    written; the last result stays until the session's owner deletes it, for the rows are read later.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(path)
        if before:
            at = spark._jvm.org.apache.hadoop.fs.Path(before)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        before = path
    return docs
