"""Session settings and the place where intermediate tables are kept."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Everything here is a runtime SQL option, so it can be set on a running session.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Per-app "newest N" keeps up to 7000 rows; let the scan side drop the rest
    # before the shuffle (the built-in cut-off is 1000).
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
    # Hash joins instead of sorting both sides, where every measured partition is small.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # Text work costs far more per byte than the 1 MB default assumes; without
    # this, small stages collapse into one task.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
}

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tune(spark: SparkSession) -> SparkSession:
    """Apply the recommended runtime options to an existing session."""
    for key, value in RECOMMENDED_CONF.items():
        spark.conf.set(key, value)
    return spark


# Folder of a local session without `spark.checkpoint.dir`: that option can't be set on a running session.
_local_folder: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: `spark.checkpoint.dir` as the cluster names it.

    Without that setting a folder is made only for a local master, where driver
    and executors share one machine.
    """
    global _local_folder
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="voicegrid-")
    return _local_folder


def materialize(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write `df` once as a table in the shared folder and read it back.

    The lineage ends at the files, so a lost executor costs one re-read, and the
    table can feed several later steps without being computed again. `codec` is for large tables (zstd).
    """
    path = os.path.join(shared_dir(df.sparkSession), f"{label}-{uuid.uuid4().hex}")
    return _stored([df], path, codec)


@contextmanager
def passing(parts: Iterable[DataFrame], label: str, codec: str | None = None) -> Iterator[DataFrame]:
    """Like `materialize` for the rows of all `parts`, written one after the other, so that each part's shuffle is gone before the next.

    The table is deleted at the end, so what reads it has to be stored by then.
    """
    parts = list(parts)
    spark = parts[0].sparkSession
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    try:
        yield _stored(parts, path, codec)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize_parts(parts: Iterable[DataFrame], label: str, codec: str | None = None) -> DataFrame:
    """One table with the rows of all `parts`, written one after the other."""
    parts = list(parts)
    return _stored(parts, os.path.join(shared_dir(parts[0].sparkSession), f"{label}-{uuid.uuid4().hex}"), codec)


def _stored(parts: list[DataFrame], path: str, codec: str | None) -> DataFrame:
    spark = parts[0].sparkSession
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    # Nothing else reads the shuffles of these writes; kept, they add up until the driver happens to collect its garbage.
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        for part in parts:
            writer = part.write.mode("errorifexists" if part is parts[0] else "append")
            (writer.option("compression", codec) if codec else writer).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(parts[0].schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a table of fewer files than cores one partition per core before costly text work.

    A file of one row group is one task, however many splits it has. Inputs of
    many files, as at scale, pass unchanged. With `keys`, rows of one key stay together.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if 0 < len(df.inputFiles()) < cores else df
