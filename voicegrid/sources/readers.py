"""Readers with explicit schemas; nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_REVIEWS = (
    "app_id string, app_name string, review_text string, rating int, thumbs_up bigint, "
    "review_date timestamp_ntz, reply_text string, reply_date timestamp_ntz, source string"
)
BULK_REVIEWS = (
    "app_id string, app_name string, review_id string, user_name string, review_text string, rating int, "
    "thumbs_up bigint, review_date timestamp_ntz, reply_text string, reply_date timestamp_ntz, "
    "sentiment string, category string, priority string, clean_text string, "
    "review_length int, word_count int, has_reply int, review_month string"
)
APP_METADATA = (
    "app_id string, app_name string, title string, description string, summary string, installs string, "
    "ratings bigint, score double, reviews_count bigint, free boolean, genre string, developer string"
)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and quoted line breaks.

    A file with line breaks inside quotes cannot be split, so one file is one
    task: keep single files moderate and turn large ones into parquet once.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("enforceSchema", False)
        .csv(path)
    )


def read_reviews(spark: SparkSession, path: str, schema: str = RAW_REVIEWS) -> DataFrame:
    return read_csv(spark, path, schema)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, APP_METADATA)


def read_documents(spark: SparkSession, path: str, skip_readme: bool = True) -> DataFrame:
    """(source, text) of every .md and .txt file below `path`; bytes that are no UTF-8 are dropped."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{md,txt,MD,TXT}")
        .load(path)
    )
    name = F.element_at(F.split("path", "/"), -1)
    kept = files.filter(name != "README.md") if skip_readme else files
    # Invalid sequences decode to U+FFFD, which is then removed.
    decoded = F.replace(F.expr("try_validate_utf8(make_valid_utf8(cast(content as string)))"), F.lit("�"), F.lit(""))
    return kept.select(F.col("path").alias("source"), decoded.alias("text"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet keeps the types and lets filters and column lists reach the files."""
    return spark.read.parquet(path)
