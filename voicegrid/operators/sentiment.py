"""Lexicon sentiment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicegrid.config import NEGATIVE_WORDS, POSITIVE_WORDS
from voicegrid.functions import text


def sentiment_label(score: Column) -> Column:
    return F.when(score > 0, "Positive").when(score < 0, "Negative").otherwise("Neutral")


def add_sentiment(
    df: DataFrame, positive=POSITIVE_WORDS, negative=NEGATIVE_WORDS, column: str = "review_text"
) -> DataFrame:
    """Distinct positive words minus distinct negative words, and the label of the difference."""

    def score(words):
        good = F.array(*[F.lit(w) for w in positive])
        bad = F.array(*[F.lit(w) for w in negative])
        return F.size(F.array_intersect(words, good)) - F.size(F.array_intersect(words, bad))

    scored = df.withColumn("sentiment_score", text.once(text.token_set(F.col(column)), score))
    return scored.withColumn("sentiment", sentiment_label(F.col("sentiment_score")))
