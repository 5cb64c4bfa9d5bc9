"""Profiles and themes kept up to date from a stream of analyzed reviews.

Each micro-batch is reduced to the additive measures of its apps, a few rows per app, and stored under its own number, so a batch
that runs again after a failure replaces its own rows. Every `MERGE` batches the sums so far are written as a base, which
spares readers the batches before it. Rates and themes are derived when they are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voicegrid.operators import compete

GROUP = ("app_id", "in_praise", "in_issue")
MERGE = 64


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in (*GROUP, "number", "kind")])


def _upto(stored: DataFrame, last: int | None = None) -> DataFrame:
    """Measures of all batches, or of those up to `last`: the newest base and what came after it."""
    seen = stored if last is None else stored.filter(F.col("number") <= last)
    base = seen.filter("kind = 'base'").agg(F.coalesce(F.max("number"), F.lit(-1))).first()[0]
    counted = ((F.col("kind") == "base") & (F.col("number") == base)) | ((F.col("kind") == "batch") & (F.col("number") > base))
    return _summed(seen.filter(counted))


def keep_measures(analyzed: DataFrame, path: str, checkpoint: str, patterns: dict[str, str] | None = None, merge: int = MERGE):
    """Reduce new analyzed reviews to measures under `path`; reads what is there and stops."""

    def write(batch: DataFrame, number: int) -> None:
        target = f"{path}/kind={{}}/number={number}"
        compete.measured(batch, patterns).write.mode("overwrite").parquet(target.format("batch"))
        if number % merge == merge - 1:
            # The base of this batch is left out of its own sum, if a failed run has written it already.
            stored = _stored(batch.sparkSession, path).filter((F.col("kind") == "batch") | (F.col("number") < number))
            _upto(stored, number).write.mode("overwrite").parquet(target.format("base"))

    return analyzed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def measures(spark: SparkSession, path: str) -> DataFrame:
    """The measures of all reviews so far, as `compete.measured` gives them."""
    return _upto(_stored(spark, path))


def profiles(spark: SparkSession, path: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """Rates and theme lists of every app, as `compete.profile` gives them."""
    whole = measures(spark, path)
    themes = compete.theme_lists(compete.theme_counts(whole, patterns))
    return compete.rates(whole).join(themes, "app_id", "left")
