"""All named queries, and the whole analysis as one of them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voicegrid.config import DEFAULTS
from voicegrid.operators import classify, compete, priority
from voicegrid.plans import intake_queries, model_queries, report_queries, text_queries, vector_queries  # noqa: F401
from voicegrid.plans.pipeline import enrich
from voicegrid.plans.registry import ORACLES, QUERIES, query
from voicegrid.session import materialize
from voicegrid.sources.samples import NEGATIVE, POSITIVE, TOPICS, Tables

SETTINGS = replace(DEFAULTS, positive_words=POSITIVE, negative_words=NEGATIVE, topic_patterns=TOPICS)

_WEIGHT = """CASE category WHEN 'Bug' THEN 4.0 WHEN 'Performance Issue' THEN 3.5 WHEN 'Complaint' THEN 3.0
 WHEN 'UI Issue' THEN 2.5 WHEN 'Feature Request' THEN 2.0 WHEN 'Praise' THEN 0.5 ELSE 1.0 END::DOUBLE"""
FLAGSHIP_CTE = f"""{report_queries.PROFILE_CTE}, {model_queries.GROUP_CTE.replace('lang AS app_id', 'source AS app_id')},
 counted AS (SELECT review_seq, duplicate_group, duplicate_count FROM rows JOIN placed USING (app_id, toks)
 JOIN groups USING (app_id, component)),
 ranked AS (SELECT a.*, duplicate_group, duplicate_count, round_even(({_WEIGHT} + (5 - coalesce(rating, 3)) * 0.75::DOUBLE
 + ln(1.0 + thumbs_up) * 0.5::DOUBLE + ln(1.0 + duplicate_count) * 0.75::DOUBLE) * 1000, 0) / 1000 AS priority_score
 FROM analyzed a JOIN counted USING (review_seq)),
 features AS (SELECT app_id, duplicate_group, round_even(sum(prediction_confidence) * avg(priority_score)
 * avg(prediction_confidence) * 100, 0) / 100 AS rice_score FROM ranked WHERE category = 'Feature Request' GROUP BY 1, 2),
 best AS (SELECT * FROM features QUALIFY row_number() OVER (PARTITION BY app_id ORDER BY rice_score DESC, duplicate_group) = 1),
 per_app AS (SELECT app_id, count(*) FILTER (duplicate_count > 1) AS near_duplicates,
 count(*) FILTER (priority_score > 6.5) AS high_priority FROM ranked GROUP BY app_id)"""


@query(
    "analysis_by_app", reviews=True, recursive=True, ctes=FLAGSHIP_CTE,
    sql="""SELECT app_id, sample_size, average_rating, positive_rate, praise_rate, issue_rate, near_duplicates, high_priority,
 duplicate_group AS best_feature_group, rice_score AS best_feature_score FROM profiles JOIN per_app USING (app_id)
 LEFT JOIN best USING (app_id)""",
)
def analysis_by_app(t: Tables) -> DataFrame:
    """Route, sentiment, near-duplicates, priority, profile and best feature request of every app."""
    # Four reports read the analyzed rows.
    analyzed = materialize(enrich(classify.route(t.reviews()), SETTINGS), "analyzed", "zstd")
    profiles = compete.rates(compete.measured(analyzed, TOPICS))
    counts = analyzed.groupBy("app_id").agg(
        F.count_if(F.col("duplicate_count") > 1).alias("near_duplicates"),
        F.count_if(F.col("priority") == "High").alias("high_priority"),
    )
    best = priority.build_feature_ranking(analyzed, 1, keys=["app_id"]).select(
        "app_id", F.col("duplicate_group").alias("best_feature_group"), F.col("rice_score").alias("best_feature_score")
    )
    rates = profiles.select("app_id", "sample_size", "average_rating", "positive_rate", "praise_rate", "issue_rate")
    return rates.join(counts, "app_id").join(best, "app_id", "left")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES["analysis_by_app"](spark, folder)


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)
