"""Totals, distributions and data profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicegrid.config import CONFIDENCE_BINS
from voicegrid.functions import numeric, text

DIMENSIONS = ("category", "sentiment", "priority")


def unpivot(df: DataFrame, keys, pairs: dict[str, Column], name: str, value: str) -> DataFrame:
    """One row per entry of `pairs`, in the given order."""
    entries = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(label).alias(name), column.alias(value))
        for i, (label, column) in enumerate(pairs.items())
    ])
    return df.select(*keys, F.inline(entries))


def totals(df: DataFrame, keys=()) -> DataFrame:
    """Rows, mean rating, queue length and mean confidence in one aggregation."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("total_reviews"),
        numeric.round_even(F.avg(numeric.to_number(F.col("rating"))), 2).alias("average_rating"),
        F.count_if(F.coalesce("needs_human_review", F.lit(False))).alias("low_confidence_reviews"),
        numeric.round_even(F.avg("prediction_confidence"), 3).alias("average_confidence"),
    )


def value_counts(df: DataFrame, column: str, keys=()) -> DataFrame:
    """Rows per value, nulls left out, most frequent first."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("reviews"))
    return counted.orderBy(*keys, F.desc("reviews"), column)


def distributions(df: DataFrame, columns=DIMENSIONS, keys=()) -> DataFrame:
    """Value counts of several columns from one pass, with grouping sets; per value of `keys`, if given."""
    keys = list(keys)
    grouped = df.groupingSets([[*keys, c] for c in columns], *keys, *columns).agg(
        F.count("*").alias("reviews"), F.grouping_id().alias("_set")
    )
    full = (1 << len(columns)) - 1
    dimension = value = None
    for i, c in enumerate(columns):
        own = F.col("_set") == (full & ~(1 << (len(columns) - 1 - i)))
        dimension = F.when(own, c) if dimension is None else dimension.when(own, c)
        value = F.when(own, F.col(c)) if value is None else value.when(own, F.col(c))
    named = grouped.select(*keys, dimension.alias("dimension"), value.alias("value"), "reviews")
    return named.filter(F.col("value").isNotNull())


def confidence_diagnostics(df: DataFrame, digits: int = 3, keys=()) -> DataFrame:
    """Lowest, highest and mean confidence; null when there is none."""
    confidence = numeric.to_number(F.col("prediction_confidence"))
    return df.groupBy(*keys).agg(
        numeric.round_even(F.min(confidence), digits).alias("minimum"),
        numeric.round_even(F.max(confidence), digits).alias("maximum"),
        numeric.round_even(F.avg(confidence), digits).alias("mean"),
    )


def confidence_histogram(df: DataFrame, keys=()) -> DataFrame:
    """Every bin in order, empty ones with 0: conditional counts in one pass, then unpivoted."""
    label = numeric.confidence_bin(numeric.to_number(F.col("prediction_confidence")))
    binned = df.withColumn("_bin", label)
    counted = binned.groupBy(*keys).agg(
        *[F.count_if(F.col("_bin") == name).alias(f"_b{i}") for i, (_, name) in enumerate(CONFIDENCE_BINS)]
    )
    pairs = {name: F.col(f"_b{i}") for i, (_, name) in enumerate(CONFIDENCE_BINS)}
    return unpivot(counted, keys, pairs, "bin", "reviews")


def route_counts(df: DataFrame, keys=()) -> DataFrame:
    """Reviews open for a model or for translation; absent columns count as none."""
    llm = F.coalesce("requires_llm_review", F.lit(False)) if "requires_llm_review" in df.columns else F.lit(False)
    route = F.col("review_route") if "review_route" in df.columns else F.lit("")
    return df.groupBy(*keys).agg(
        F.count_if(llm).alias("llm_ambiguity_reviews"),
        F.count_if(route == "translation_or_human").alias("translation_or_human_reviews"),
    )


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column, all columns in one pass."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return unpivot(counted, [], {c: F.col(c) for c in df.columns}, "column_name", "nulls").drop("position")


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def head(df: DataFrame, n: int, seq: str = "review_seq") -> DataFrame:
    return df.orderBy(seq).limit(n)


def of_app(df: DataFrame, app: str, column: str = "app_name") -> DataFrame:
    """Rows of one app, whatever the case of its name."""
    return df.filter(F.lower(column) == app.lower())


def app_report(df: DataFrame, app: str, column: str = "app_name") -> DataFrame:
    """Total, mean rating and category distribution of one app, one row per category."""
    grouped = of_app(df, app, column).groupBy("category").agg(
        F.count("*").alias("reviews"), F.sum("rating").alias("_sum"), F.count("rating").alias("_rated")
    )
    total = grouped.agg(
        F.sum("reviews").alias("total_reviews"),
        numeric.round_even(F.sum("_sum") / F.nullif(F.sum("_rated"), F.lit(0)), 2).alias("average_rating"),
    )
    listed = grouped.filter(F.col("category").isNotNull()).select("category", "reviews")
    return listed.withColumns({
        "total_reviews": total.select("total_reviews").scalar(),
        "average_rating": total.select("average_rating").scalar(),
    }).orderBy(F.desc("reviews"), "category")


def category_samples(df: DataFrame, category: str, n: int = 10, seq: str = "review_seq", column: str = "clean_text") -> DataFrame:
    return df.filter(F.col("category") == category).orderBy(seq).limit(n).select(seq, column)


def queue_quality(df: DataFrame, keys=()) -> DataFrame:
    """Queued and uninterpretable reviews with their shares in percent."""
    queued = F.count_if(F.coalesce("needs_human_review", F.lit(False)))
    unclear = F.count_if(~text.is_interpretable(F.col("review_text")))
    total = F.greatest(F.count("*"), F.lit(1))
    return df.groupBy(*keys).agg(
        F.count("*").alias("sample_size"),
        queued.alias("queued_reviews"),
        numeric.rate(queued / total).alias("queued_share"),
        unclear.alias("uninterpretable_reviews"),
        numeric.rate(unclear / total).alias("uninterpretable_share"),
    )
