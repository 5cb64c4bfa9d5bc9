"""The driver tables in the shape of the review tables.

`Tables` reads one data folder; its methods give the projections that the
catalogue queries run on. Every projection covers its whole table. The SQL texts
below state the same projections for the checks in plain SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CATEGORY = """CASE doc_id % 6 WHEN 0 THEN 'Bug' WHEN 1 THEN 'Complaint' WHEN 2 THEN 'Feature Request'
 WHEN 3 THEN 'Performance Issue' WHEN 4 THEN 'Praise' ELSE 'UI Issue' END"""

REVIEW_COLUMNS = {
    "review_seq": "doc_id",
    "app_id": "source",
    "review_text": "text",
    "rating": "CASE WHEN doc_id % 17 = 0 THEN NULL ELSE CAST(doc_id % 5 + 1 AS DOUBLE) END",
    "thumbs_up": "n_chars % 50",
    "category": _CATEGORY,
    "prediction_confidence": "CAST((doc_id * 37) % 101 AS DOUBLE) / 100",
    "vocabulary_hits": "doc_id % 3",
}
REVIEWS_SQL = (
    "reviews AS (SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in REVIEW_COLUMNS.items()) + " FROM documents)"
)
DATED_SQL = """dated AS (SELECT r.*, e.ts AS review_date, c.text AS reply_text, c.text IS NOT NULL AS replied
 FROM reviews r LEFT JOIN events e ON e.event_id = r.review_seq
 LEFT JOIN (SELECT conv_id, text FROM conversations WHERE turn = 1) c ON c.conv_id = r.review_seq)"""

# Word lists that occur in the test texts.
POSITIVE = ("that", "this", "with", "for")
NEGATIVE = ("ha", "er", "re", "an")
STOPWORDS = ("the", "and", "of", "to", "a", "in", "is")
TOPICS = {
    "pointing": r"(^|[^a-z])(that|this)([^a-z]|$)",
    "linking": r"(^|[^a-z])(and|with)([^a-z]|$)",
    "asking": r"(^|[^a-z])(what|which|whether)([^a-z]|$)",
    "french": r"(^|[^a-z])(les|des|une)([^a-z]|$)",
    "german": r"(^|[^a-z])(der|die|das)([^a-z]|$)",
    "spanish": r"(^|[^a-z])(los|las|una)([^a-z]|$)",
    "place": r"(^|[^a-z])(in|on|at)([^a-z]|$)",
}


class Tables:
    """Tables of one folder and the review-shaped projections of them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def reviews(self) -> DataFrame:
        return self.documents.selectExpr(*[f"{sql} AS {name}" for name, sql in REVIEW_COLUMNS.items()])

    def dated(self) -> DataFrame:
        """Reviews with date and reply."""
        reviews = self.reviews()
        dates = self.events.select(F.col("event_id").alias("review_seq"), F.col("ts").alias("review_date"))
        replies = self.conversations.filter("turn = 1").select(
            F.col("conv_id").alias("review_seq"), F.col("text").alias("reply_text")
        )
        return reviews.join(dates, "review_seq", "left").join(replies, "review_seq", "left")
