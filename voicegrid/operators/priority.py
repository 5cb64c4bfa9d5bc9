"""Priority of reviews and ranking of feature requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicegrid.config import CATEGORY_WEIGHTS, DEFAULTS, OTHER_CATEGORY_WEIGHT
from voicegrid.functions import numeric
from voicegrid.operators.skew import top_n_per_key


def category_weight(category: Column, weights=None) -> Column:
    chain = None
    for label, weight in (weights or CATEGORY_WEIGHTS).items():
        branch = (F if chain is None else chain).when(category == label, float(weight))
        chain = branch
    return chain.otherwise(OTHER_CATEGORY_WEIGHT)


def _number(df: DataFrame, name: str, default: float) -> Column:
    """Numeric column with a default for bad values; the default alone when it is absent."""
    if name not in df.columns:
        return F.lit(float(default))
    return F.coalesce(numeric.to_number(F.col(name)), F.lit(float(default)))


def add_priority(df: DataFrame, weights=None) -> DataFrame:
    rating = numeric.clip(_number(df, "rating", 3), 1, 5)
    thumbs = numeric.clip(_number(df, "thumbs_up", 0), low=0)
    copies = _number(df, "duplicate_count", 1)
    raw = (
        category_weight(F.col("category"), weights)
        + (5 - rating) * 0.75
        + F.log1p(thumbs) * 0.5
        + F.log1p(copies) * 0.75
    )
    scored = df.withColumn("priority_score", numeric.round_even(raw, 3))
    return scored.withColumn("priority", numeric.priority_band(F.col("priority_score")))


def feature_groups(df: DataFrame, keys=(), seq: str = "review_seq") -> DataFrame:
    """Feature requests per duplicate group; partial aggregation absorbs large groups."""
    first_text = F.min_by("review_text", F.when(F.col("review_text").isNotNull(), F.col(seq)))
    return (
        df.filter(F.col("category") == "Feature Request")
        .groupBy(*keys, "duplicate_group")
        .agg(
            first_text.alias("request"),
            F.count("*").alias("reach"),
            F.avg("priority_score").alias("average_priority"),
            F.avg("prediction_confidence").alias("confidence"),
            F.sum("prediction_confidence").alias("evidence_weight"),
        )
    )


def with_rice(groups: DataFrame) -> DataFrame:
    """Uncertain labels keep their reach but weigh less."""
    score = F.col("evidence_weight") * F.col("average_priority") * F.col("confidence")
    return groups.withColumn("rice_score", numeric.round_even(score, 2))


def build_feature_ranking(df: DataFrame, limit: int = DEFAULTS.feature_limit, keys=(), seq: str = "review_seq") -> DataFrame:
    """Best feature requests overall, or per `keys`; equal scores go by group id."""
    ranked = with_rice(feature_groups(df, keys, seq))
    order = [F.desc("rice_score"), F.asc("duplicate_group")]
    if not keys:
        return ranked.orderBy(*order).limit(limit)
    return top_n_per_key(ranked, list(keys), order, limit, spread="duplicate_group")


def with_rationale(ranking: DataFrame) -> DataFrame:
    return ranking.withColumn(
        "rationale",
        F.format_string(
            "Ranked from %d grouped request(s), average priority %.2f, and classification confidence %.2f. "
            "Validate user reach and effort with analytics and engineering before roadmap commitment.",
            "reach", "average_priority", "confidence",
        ),
    )
