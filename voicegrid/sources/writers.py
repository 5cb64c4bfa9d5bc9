"""Sinks. Partition columns take the place of one file name per run or app."""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Files of pages in one folder.
FOLDER_FILES = 1000


def write_raw(reviews: DataFrame, path: str, ingested: Column | None = None, fmt: str = "parquet") -> None:
    """Append raw reviews under app_id and intake time."""
    stamp = F.date_format(F.current_timestamp() if ingested is None else ingested, "yyyyMMdd_HHmmss")
    stamped = reviews.withColumn("ingest_ts", stamp)
    _writer(stamped, fmt).mode("append").partitionBy("app_id", "ingest_ts").save(path)


def write_bulk(reviews: DataFrame, metadata: DataFrame, folder: str, fmt: str = "csv") -> None:
    """Reviews and app metadata of a bulk collection."""
    _writer(reviews, fmt).mode("overwrite").save(f"{folder}/feedback_data")
    _writer(metadata, fmt).mode("overwrite").save(f"{folder}/app_metadata")


def write_run(analyzed: DataFrame, path: str, run_id: str | None = None) -> None:
    """Analyzed rows of a run."""
    _by_run(analyzed, path, run_id)


def write_review_queue(analyzed: DataFrame, path: str, run_id: str | None = None) -> None:
    """Rows waiting for a person."""
    _by_run(review_queue(analyzed), path, run_id)


def review_queue(analyzed: DataFrame) -> DataFrame:
    return analyzed.filter("needs_human_review")


def write_clean_corpus(corpus: DataFrame, path: str, fmt: str = "csv") -> None:
    _writer(corpus, fmt).mode("overwrite").save(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def write_features(features: DataFrame, path: str) -> None:
    """Vector columns keep their type in parquet."""
    features.write.mode("overwrite").parquet(path)


def write_knowledge(documents: DataFrame, path: str) -> None:
    documents.write.mode("append").parquet(path)


def save_model(model, path: str) -> None:
    """Text features, classifier and labels are one pipeline, so one artifact."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def write_pages(pages: DataFrame, path: str) -> None:
    """(page_id, value) as text files below `path`: a task writes one file per page, with a line for each row, into folders of many files.

    A folder for every page would cost a listing and several calls for every file. File systems that only Spark knows get those folders.
    """
    target = pages.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(pages.sparkSession._jsc.hadoopConfiguration())
    target = store.makeQualified(target)
    if target.toUri().getScheme() != "file":
        pages.write.partitionBy("page_id").text(path)
        return
    store.mkdirs(target)
    root = target.toUri().getPath()

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, files = TaskContext.get().partitionId(), 0
        rows = (row for part in parts for row in zip(part.column(0).to_pylist(), part.column(1).to_pylist()))
        for page, held in itertools.groupby(rows, key=lambda row: row[0]):
            if files % FOLDER_FILES == 0:
                folder = f"{root}/pages-{number:05d}-{files // FOLDER_FILES:05d}"
                os.makedirs(folder, exist_ok=True)
            name = "__HIVE_DEFAULT_PARTITION__" if page is None else page
            # A repeated task writes the same files again.
            with open(f"{folder}/part-{number:05d}-page_id={name}.txt", "wb") as out:
                out.writelines((value or "").encode() + b"\n" for _, value in held)
            files += 1
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    pages.select("page_id", "value").sortWithinPartitions("page_id").mapInArrow(write, "files bigint").agg({"files": "sum"}).collect()


def _by_run(rows: DataFrame, path: str, run_id: str | None) -> None:
    tagged = rows if run_id is None else rows.withColumn("run_id", F.lit(run_id))
    # Only the partitions of this run are replaced, so a repeated run is safe.
    tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def _writer(df: DataFrame, fmt: str):
    writer = df.write.format(fmt)
    if fmt == "csv":
        writer = (
            writer.option("header", True)
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
        )
    return writer
