"""The newest rows of every key, found before any wide row moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voicegrid.operators.skew import join_frequent, top_n_per_key
from voicegrid.session import materialize

# Width of a histogram's bucket: a day.
WIDTH = 86_400_000_000
# One narrow row per key is broadcast up to this many keys.
KEYS_SENT = 1_000_000


def moment(column: Column) -> Column:
    """Microseconds of a date or timestamp; rows without one come before all others."""
    return F.coalesce(F.unix_micros(column.cast("timestamp")), F.lit(-(1 << 62)))


def cut_offs(rows: DataFrame, count: int, width: int = WIDTH) -> DataFrame:
    """Stored (key, rows, until, last) of (key, at, seq): the `count` newest have at > until, or at = until and seq <= last.

    `until` is null for keys with no more rows than that. A histogram tells each key's day of the cut-off. Only rows of that day are
    ranked, in two levels, as all rows of a key may have one day.
    """
    bucket = F.floor(F.col("at") / F.lit(width)).cast("bigint")
    held = materialize(rows.groupBy("key", bucket.alias("bucket")).agg(F.count("*").alias("held")), "histogram")
    newer = W.partitionBy("key").orderBy(F.desc("bucket")).rowsBetween(W.unboundedPreceding, -1)
    border = held.withColumn("newer", F.coalesce(F.sum("held").over(newer), F.lit(0))).filter(
        (F.col("newer") < count) & (F.col("newer") + F.col("held") >= count)
    )
    border = border.select("key", "bucket", "held", (F.lit(count) - F.col("newer")).alias("need"))
    inside = join_frequent(rows.withColumn("bucket", bucket), border, ["key", "bucket"], "held", hot_keys=KEYS_SENT, stored=True)
    order = [F.desc("at"), F.asc("seq")]
    ranked = top_n_per_key(inside, ["key"], order, count, spread="seq", slices=64)
    last = ranked.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy(*order))).filter("rank = need")
    totals = held.groupBy("key").agg(F.sum("held").alias("rows"))
    return materialize(totals.join(last.select("key", F.col("at").alias("until"), F.col("seq").alias("last")), "key", "left"), "cut-offs")


def newest(df: DataFrame, key: str, time: str, seq: str, count: int) -> DataFrame:
    """The `count` newest rows of every key; undated ones last, ties by `seq`, which is unique. A null key is a key.

    Three reads of `df`: two of its key, time and number for the cut-offs, and one that filters. Rows are not shuffled.
    """
    named = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("none"))
    ends = cut_offs(df.select(named.alias("key"), moment(F.col(time)).alias("at"), F.col(seq).alias("seq")), count)
    ends = ends.select(F.col("key").alias("_key"), F.col("rows").alias("_rows"), F.col("until").alias("_until"), F.col("last").alias("_last"))
    told = join_frequent(df.withColumn("_key", named), ends, ["_key"], "_rows", hot_keys=KEYS_SENT, stored=True)
    at = moment(F.col(time))
    kept = F.col("_until").isNull() | (at > F.col("_until")) | ((at == F.col("_until")) & (F.col(seq) <= F.col("_last")))
    return told.filter(kept).select(*df.columns)
