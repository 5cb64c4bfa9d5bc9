"""Corpus pipeline: language, copies, near-copies, secrets, packing. Each stage takes what its predecessor kept."""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voicegrid.llm import langid, packing, secrets, simhash
from voicegrid.llm.common import drop_rows, free_name, prepare, with_row_id
from voicegrid.llm.exact_dedup import exact_dedup
from voicegrid.session import shared_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a known language go: no letter, or like none of the labelled languages.

    Null texts count as empty, so they go. Where no row is labelled nothing is known, and all rows stay, as in an empty table.
    Repeated rows are judged alike; a null source or language is missing evidence.
    """
    prepare(spark)
    rejected = free_name(docs, "_rejected")
    facts = docs.select("*", F.struct(*docs.columns).alias(whole := free_name(docs, "_whole")))
    found = langid.identify(
        facts.select(F.col("text"), F.col("lang").alias("declared"), F.col("source").alias("host"), whole),
        langid.fit(docs), declared="declared", host="host",
    )
    return found.select(f"{whole}.*", F.col("rejected").alias(rejected)).filter(~F.col(rejected)).drop(rejected)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (but for white space) the one with the smallest id stays.

    Null texts are empty texts, and copies of each other. Of rows that repeat an id, or have none, one stays. An empty table stays empty.
    """
    prepare(spark)
    row = free_name(docs, "_row")
    stored = with_row_id(docs, row)
    found = exact_dedup(stored, carry=[row])
    return drop_rows(stored, found.filter("NOT kept"), row).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document with the smallest id stays.

    Texts without words are near-duplicates of each other. Rows that repeat the smallest id, and groups without any id, keep one row.
    """
    prepare(spark)
    row = free_name(docs, "_row")
    stored = with_row_id(docs, row)
    found = simhash.near_duplicates(stored, carry=[row], group="group")
    alone = found.filter("doc_id IS NULL OR doc_id <> component_id")
    # Rows that repeat the id of a group's first one, and groups without any id: the first row stays.
    first = found.filter("doc_id = component_id").groupBy("component_id").agg(F.min(row).alias("first"), F.count("*").alias("held"))
    more = found.filter("doc_id = component_id").join(first.filter("held > 1"), "component_id").filter(F.col(row) != F.col("first"))
    nameless = found.filter("component_id IS NULL").groupBy("group").agg(F.min(row).alias(row))
    drop = alone.select(row).join(nameless.select(row), row, "left_anti").unionByName(more.select(row))
    return drop_rows(stored, drop, row).select(*docs.columns)


def secret_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by a mark, and n_chars follows. Null texts stay null."""
    prepare(spark)
    spans = free_name(docs, "_spans")
    clean = secrets.secret_spans(docs, name=spans).withColumn("text", secrets.redacted(F.col("text"), F.col(spans)))
    changed = F.size(spans) > 0
    return clean.withColumn("n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents (doc_id, start, length, ids, doc_tokens) in sequences (sequence_id, offset) of 2048 ids."""
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("secret_scan", secret_free),
    ("packing", packed),
]
# Two stages rest on trained models and tokenizers: tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = os.path.join(shared_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    for number, (name, stage) in enumerate(STAGES):
        path = os.path.join(folder, f"{number}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
