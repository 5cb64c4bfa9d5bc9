"""Continuous intake of review pages.

Review files arrive page after page and snapshots overlap. A file stream keeps
track of the pages it has read (the checkpoint is the continuation token), and
each micro-batch is merged into the raw table by review key: a review is stored once,
however late its page comes, and the result doesn't depend on the size of a micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voicegrid.operators.intake import review_key
from voicegrid.sources.readers import RAW_REVIEWS

NAMED_APPS = 1000
FILES_PER_APP = 8


def review_pages(spark: SparkSession, folder: str, schema: str = RAW_REVIEWS, pages_per_batch: int = 200) -> DataFrame:
    """Stream of raw review rows from CSV pages, with a stable key."""
    pages = (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("maxFilesPerTrigger", pages_per_batch)
        .csv(folder)
    )
    key = review_key(F.col("app_id"), F.col("review_date"), F.coalesce("review_text", F.lit("")))
    if "review_id" in pages.columns:
        # Feeds with their own ids: two people may write the same words in the same second.
        known = F.sha2(F.concat_ws("\u0001", "app_id", "review_id"), 256)
        key = F.when(F.col("review_id").isNotNull(), known).otherwise(key)
    return pages.withColumn("review_key", key)


def of_apps(stored: DataFrame, apps: DataFrame, most: int = NAMED_APPS) -> DataFrame:
    """Rows of `stored` (partitioned by app_id) whose app is among the distinct `apps`; only their folders are read.

    Up to `most` apps are named in the filter, which prunes partitions when the plan is made; more are joined by equality.
    """
    first = [r["app_id"] for r in apps.limit(most + 1).collect()]
    if len(first) <= most:
        named = F.col("app_id").isin([a for a in first if a is not None])
        return stored.filter(named | F.col("app_id").isNull() if None in first else named)
    equal = stored.join(apps.filter("app_id IS NOT NULL"), "app_id", "left_semi")
    return equal.unionByName(stored.filter("app_id IS NULL")) if apps.filter("app_id IS NULL").count() else equal


def append_raw(reviews: DataFrame, path: str, checkpoint: str):
    """Merge new reviews into the raw table, partitioned by app; reads what is there and stops.

    A micro-batch reads the keys of the apps it holds, and appends the reviews whose key is not there yet. A batch
    that runs again after a failure finds its own keys and adds nothing.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["review_key"])
        if _exists(spark, path):
            stored = spark.read.schema(batch.schema).parquet(path).select("app_id", "review_key")
            known = of_apps(stored, batch.select("app_id").distinct()).select("review_key")
            fresh = fresh.join(known, "review_key", "left_anti").select(*batch.columns)
        # A few files per app and batch, also of an app that holds most of the reviews.
        slot = F.pmod(F.xxhash64("review_key"), F.lit(FILES_PER_APP))
        fresh.repartition("app_id", slot).write.mode("append").partitionBy("app_id").parquet(path)

    return (
        reviews.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
