"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voicegrid.session import materialize, tune

# A lookup is broadcast up to this many rows, each of a few dozen bytes.
SMALL_ROWS = 100_000

# Lines of the plan of a table as it was read.
BARE = re.compile(r"[\s:+-]*(Project|Filter|Relation|SubqueryAlias)\b")

# Python tasks hold one batch of whole texts at a time: bounded by rows and by bytes.
ARROW_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime options for the operators of this folder."""
    tune(spark)
    for key, value in ARROW_CONF.items():
        spark.conf.set(key, value)
    return spark


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that `df` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """`df` with a column that names each row and stays the same in later reads.

    Rows of a file are named by file and place. Other rows are written once, with a number; so are those behind a join or
    a generator, which repeat a row of a file.
    """
    try:
        # A plan of scan, projection and filter only.
        plan = df._jdf.queryExecution().analyzed().toString().splitlines()
        if not all(BARE.match(line) for line in plan):
            raise AnalysisException("rows of the files may repeat")
        place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        return df.select("*", place.alias(name))
    except AnalysisException:
        place = F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("row"))
        return materialize(df.withColumn(name, place), "numbered")


def lookup_left(
    rows: DataFrame, entries: DataFrame, keys: Sequence[str], frequency: str, small: int = SMALL_ROWS
) -> DataFrame:
    """Left join of long `rows` to stored `entries` with one row per key.

    `frequency` says how many of `rows` carry the key. Up to `small` entries are
    broadcast. Beyond that, keys carried by more than 1/small of all rows (so fewer than
    `small` of them) are broadcast and the others are joined by shuffle, so no task gets
    one frequent key.
    """
    keys = list(keys)
    size, total = entries.agg(F.count("*"), F.coalesce(F.sum(frequency), F.lit(0))).first()
    if size <= small:
        return rows.join(F.broadcast(entries), keys, "left")
    is_hot = F.col(frequency) > F.lit(int(total) // small)
    hot, cold = entries.filter(is_hot), entries.filter(~is_hot)
    frequent = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, "left")
    return frequent.unionByName(rest)


def drop_rows(docs: DataFrame, dropped: DataFrame, row_id: str, small: int = SMALL_ROWS) -> DataFrame:
    """`docs` without the rows whose `row_id` is in `dropped`; that is broadcast only if it is small."""
    dropped = materialize(dropped.select(row_id), "dropped")
    if dropped.count() <= small:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, row_id, "left_anti")
