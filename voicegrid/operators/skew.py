"""Building blocks that keep one very frequent key from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voicegrid.session import materialize

# Upper bound of an explicitly broadcast list of narrow rows (about 100 bytes each).
HOT_KEYS = 100_000
SLICES = 1024
# Rows of either side in one cell of a many-to-many join.
CELL_ROWS = 512


def top_n_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, spread: str, slices: int = SLICES
) -> DataFrame:
    """Exact first `n` rows of every key.

    The first pass ranks inside (key, slice), so a key holding a third of the
    table is sorted by many tasks; the second pass sees at most n x slices rows
    of a key. The first n rows of a key are always among the slice winners.
    """
    slice_no = F.pmod(F.xxhash64(spread), F.lit(slices))
    local = W.partitionBy(*keys, "_slice").orderBy(*order)
    whole = W.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_slice", slice_no)
        .withColumn("_rank", F.row_number().over(local))
        .filter(F.col("_rank") <= n)
        .withColumn("_rank", F.row_number().over(whole))
        .filter(F.col("_rank") <= n)
        .drop("_slice", "_rank")
    )


def join_frequent(
    rows: DataFrame, lookup: DataFrame, keys: Sequence[str], frequency: str,
    hot_keys: int = HOT_KEYS, stored: bool = False, counts: DataFrame | None = None,
) -> DataFrame:
    """Inner join of a long table to a lookup with one row per key.

    `frequency` tells how many of `rows` carry the key. One small aggregation
    over the lookup (or over `counts`, a cheaper table with the same keys and
    frequencies) decides:

    * at most `hot_keys` rows: broadcast;
    * no key above 1/hot_keys of all rows: plain shuffle join;
    * otherwise the keys above that share, of which there can be no more than
      `hot_keys`, are broadcast, and the others are shuffled.
    """
    keys = list(keys)
    size, total, top = (lookup if counts is None else counts).agg(
        F.count("*"), F.coalesce(F.sum(frequency), F.lit(0)), F.coalesce(F.max(frequency), F.lit(0))
    ).first()
    if size <= hot_keys:
        return rows.join(F.broadcast(lookup), keys)
    share = float(total) / hot_keys
    if top <= share:
        return rows.join(lookup, keys)
    if not stored:
        lookup = materialize(lookup, "lookup")
    is_hot = F.col(frequency) > F.lit(share)
    hot = lookup.filter(is_hot)
    frequent = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(lookup.filter(~is_hot), keys)
    return frequent.unionByName(rest)


def dealt_cells(
    left: DataFrame, right: DataFrame, keys: Sequence[str], depth: int = CELL_ROWS
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of a many-to-many join, and the columns to join them on, so that no task gets a whole frequent key.

    The pairs of a key with m left and n right rows form an m x n area. It is cut into cells of about `depth` x `depth`
    pairs; a left row goes to every cell of its line, a right row to every cell of its column. A key below `depth`
    on both sides is one cell, so its rows are not repeated.
    """
    keys = list(keys)
    lefts = left.groupBy(*keys).agg(F.count("*").alias("_lefts"))
    rights = right.groupBy(*keys).agg(F.count("*").alias("_rights"))
    cells = materialize(lefts.join(rights, keys), "cells")

    def cut(side: DataFrame, own: str, count: str, other: str, other_count: str) -> DataFrame:
        sized = join_frequent(side, cells, keys, count, stored=True)
        lines = [F.ceil(F.col(c) / F.lit(float(depth))).cast("int") for c in (count, other_count)]
        # Rows of a side differ, so a hash of the whole row deals them evenly.
        placed = sized.withColumn(own, F.pmod(F.xxhash64(*side.columns), lines[0]).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), lines[1] - 1))).drop(count, other_count)

    return (
        cut(left, "_line", "_lefts", "_column", "_rights"), cut(right, "_column", "_rights", "_line", "_lefts"), [*keys, "_line", "_column"],
    )


def depth_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "_range") -> DataFrame:
    """Stored `df` with the number of the row's range in the order by `keys`, then `order`.

    Cut points are quantiles that Spark samples from the rows, so all ranges are of about one depth whatever the gaps and
    outliers of the order, and a key spans as many ranges as it needs. `df` is read twice, so it should be stored.
    """
    return materialize(df.repartitionByRange(*keys, *order).withColumn(name, F.spark_partition_id()), "ranges")


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: str, name: str
) -> DataFrame:
    """Add `name`: the sum of the bigint `value` over the key's earlier rows, in `order`.

    Each range of `depth_ranges` is summed up by itself and shifted by the key's ranges before it: that
    window holds one row per range. `keys` may not be null; rows that tie in `order` may take each other's place.
    """
    keys = list(keys)
    placed = depth_ranges(df, keys, order)
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_range", *keys)
        .agg(F.sum(value).alias("_sum"))
        .withColumn("_shift", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        .drop("_sum")
    )
    inside = W.partitionBy("_range", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = placed.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(offsets, ["_range", *keys]).withColumn(name, F.col(name) + F.col("_shift")).drop("_range", "_shift")


def number_rows(df: DataFrame, keys: Sequence[str], order: str, name: str) -> DataFrame:
    """Consecutive numbers from 1 per key, by a bigint column that is unique per key; rows without a key have none."""
    kept = df.dropna(subset=list(keys)) if keys else df
    counted = materialize(kept.withColumn("_one", F.lit(1).cast("bigint")), "numbered")
    return running_sums(counted, keys, [order], "_one", name).withColumn(name, F.col(name) + 1).drop("_one")
