"""Shaping collected reviews and app metadata into the canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voicegrid.config import DEFAULTS, REVIEW_SOURCE
from voicegrid.functions import numeric, text
from voicegrid.operators.selection import newest

REVIEW_COLUMNS = (
    "app_id", "app_name", "review_text", "rating", "thumbs_up",
    "review_date", "reply_text", "reply_date", "source",
)
PLACEHOLDERS = ("sentiment", "category", "priority", "clean_text")
METADATA_COLUMNS = (
    "app_id", "app_name", "title", "description", "summary", "installs",
    "ratings", "score", "reviews_count", "free", "genre", "developer",
)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail while the plan is built, before any job runs."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def require_rows(df: DataFrame, what: str = "reviews") -> DataFrame:
    """An empty collection is an error; reads one row at most."""
    if df.isEmpty():
        raise RuntimeError(f"no {what} were collected")
    return df


def project_reviews(records: DataFrame) -> DataFrame:
    """Store records (content, score, thumbsUpCount, at, ...) to the canonical review columns."""
    return records.select(
        "app_id",
        "app_name",
        F.col("content").alias("review_text"),
        F.col("score").alias("rating"),
        F.col("thumbsUpCount").cast("bigint").alias("thumbs_up"),
        F.col("at").alias("review_date"),
        F.col("replyContent").alias("reply_text"),
        F.col("repliedAt").alias("reply_date"),
        F.lit(REVIEW_SOURCE).alias("source"),
    )


def review_key(app_id, review_date, review_text):
    """Stable identity for feeds without a review id; equal snapshots give equal keys."""
    return F.sha2(F.concat_ws("\u0001", app_id, review_date.cast("string"), review_text), 256)


def latest_reviews(reviews: DataFrame, count: int = DEFAULTS.review_count, seq: str = "review_seq") -> DataFrame:
    """Newest `count` reviews of every app, undated ones last."""
    return newest(reviews, "app_id", "review_date", seq, count)


def bulk_reviews(feeds: list[DataFrame], count: int = DEFAULTS.bulk_review_count, seq: str = "review_seq") -> DataFrame:
    """Union of several app lists, newest `count` per app, with empty model columns."""
    everything = feeds[0]
    for feed in feeds[1:]:
        everything = everything.unionByName(feed, allowMissingColumns=True)
    return with_placeholders(latest_reviews(everything, count, seq))


def with_placeholders(reviews: DataFrame) -> DataFrame:
    return reviews.withColumns({name: F.lit(None).cast("string") for name in PLACEHOLDERS})


def with_text_stats(reviews: DataFrame, column: str = "review_text") -> DataFrame:
    """Length, word count, reply flag and month."""
    return reviews.withColumns({
        "review_length": text.text_length(F.col(column)),
        "word_count": text.word_count(F.col(column)),
        "has_reply": text.has_reply(F.col("reply_text")),
        "review_month": numeric.month(F.col("review_date")),
    })


def app_metadata(records: DataFrame) -> DataFrame:
    """Store app records to the twelve metadata columns."""
    return records.select(
        "app_id", "app_name", "title", "description", "summary", "installs",
        F.col("ratings").cast("bigint").alias("ratings"),
        F.col("score").cast("double").alias("score"),
        F.col("reviews").cast("bigint").alias("reviews_count"),
        F.col("free").cast("boolean").alias("free"),
        "genre", "developer",
    )


# Reported name -> column of the app dimension.
APP_INFO_FIELDS = {
    "App Name": "title", "Developer": "developer", "Category": "genre", "Rating": "score",
    "Total Ratings": "ratings", "Downloads": "installs", "Released": "released",
    "Last Updated": "updated", "Version": "version", "Size": "size", "Description": "description",
}


def app_information(requests: DataFrame, apps: DataFrame) -> DataFrame:
    """Renamed app info per requested id; unknown ids carry a text in `Error`."""
    dimension = apps.select(
        F.col("app_id").alias("_id"),
        *[
            (F.col(source) if source in apps.columns else F.lit(None).cast("string")).alias(shown)
            for shown, source in APP_INFO_FIELDS.items()
        ],
    )
    joined = requests.join(dimension, F.col("app_id") == F.col("_id"), "left")
    missing = F.format_string("App not found: %s", F.col("app_id"))
    return joined.withColumn("Error", F.when(F.col("_id").isNull(), missing)).drop("_id")


def clean_corpus(reviews: DataFrame, stopwords=(), source: str | None = None) -> DataFrame:
    """Drop blank reviews, clean the text, recompute its statistics, drop what became blank."""
    from voicegrid.config import CLEAN_CORPUS_SOURCE

    kept = reviews.filter(~text.is_blank(F.col("review_text")))
    cleaned = kept.withColumn("clean_text", text.clean_text(F.col("review_text"), stopwords))
    return cleaned.filter(F.col("clean_text") != "").withColumns({
        "review_length": text.text_length(F.col("clean_text")),
        "word_count": text.word_count(F.col("clean_text")),
        "has_reply": text.has_reply(F.col("reply_text")),
        "source": F.lit(source or CLEAN_CORPUS_SOURCE),
    })
