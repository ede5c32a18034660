"""Corpus pipeline: language ID, quality, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.llm import langid, packing, quality, simhash, suffix
from sedimark.llm.common import removed, shared_folder
from sedimark.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.2) -> DataFrame:
    """Keeps the documents in a language that was learned: a score of `least` or more. Those without any letter (null and empty texts
    too) go. Of 2,498 held-out documents of sf0.1 none scored below 0.31; a text unlike all that was learned scores about 0.

    Learns from the texts and languages of docs. Where nothing can be learned (no row has a language) all documents with a letter
    stay. Further columns are dropped, repeated rows are kept each; ties are those of the operator. An empty table gives no rows.
    """
    docs = docs.select(*COLUMNS)
    model = langid.fit(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return langid.classify(docs, model).where(F.col("score") >= least).where("lang_pred <> 'und'").select(*COLUMNS)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the two views together find good and not toxic; labels are those of sf_dir.

    A null text is scored as an empty one and null metadata as unknown; without labels of both classes all documents stay. Repeated
    rows are scored each, further columns are dropped, an empty table gives no rows."""
    docs = docs.select(*COLUMNS)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).where("keep").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays: the first by (doc_id, nulls
    last, then the text's hash).

    Decided per (doc_id, text): texts that share a doc_id stay or go each by its own group. Rows equal in both are one, the
    smallest by the other columns.
    """
    docs = docs.select(*COLUMNS)
    stay = simhash.similar_documents(docs).where("leads").select(F.col("doc_id").alias("__id"), F.col("node").alias("__node")).distinct()
    docs = docs.withColumn("__text", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = docs.join(stay, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__node")), "left_semi")
    rest = [c for c in COLUMNS if c != "doc_id"]
    return kept.groupBy("doc_id", "__text").agg(F.min(F.struct(*rest)).alias("row")).select("doc_id", *[F.col(f"row.{c}").alias(c) for c in rest])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes every passage of 100 bytes or more that also starts earlier, cut back to whole characters; documents of which
    nothing is left but white space go, null texts among them. n_chars is that of the new text.

    Rows equal in doc_id and text are one document to the operator, so none of them repeats another; each stays. Further columns are
    dropped, an empty table gives no rows."""
    out = suffix.remove_repeats(docs.select(*COLUMNS))
    out = out.select("doc_id", F.col("rest").alias("text"), "lang", "source")
    return out.where(F.length(F.trim("text")) > 0).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of up to 2048 tokens: one row per piece, with its ids. A null text is empty, repeated rows are packed each, ties of
    length keep the partition's order, an empty table gives no rows."""
    return packing.pack_documents(docs.select(*COLUMNS), tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("quality_filter", quality_filter),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", pack),
]

#: Trained classifiers, graph components and a tokenizer: SQL can't express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared checkpoint folder and read again. A stage's table is deleted when its
    successor's is there; the last one remains, as the result is read from it."""
    folder = f"{shared_folder(spark)}/pipeline-{os.getpid()}-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            removed(spark, f"{folder}/{before}")
        docs, before = spark.read.parquet(f"{folder}/{name}"), name
    return STAGES[-1][1](spark, docs, sf_dir)
