"""Label decisions from outside (a model or a person) applied as data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voicegrid.config import CATEGORY_LABELS, DEFAULTS
from voicegrid.functions import text
from voicegrid.operators.skew import number_rows

RESPONSE_SCHEMA = "array<struct<row: bigint, category: string>>"


def ambiguous_reviews(df: DataFrame) -> DataFrame:
    if "requires_llm_review" not in df.columns:
        return df.filter(F.lit(False))
    return df.filter("requires_llm_review")


def numbered_batches(selected: DataFrame, size: int = DEFAULTS.override_batch_rows, seq: str = "review_seq") -> DataFrame:
    """Batch number per selected row, in row order."""
    numbered = number_rows(selected, [], seq, "_n")
    return numbered.withColumn("batch", F.floor((F.col("_n") - 1) / size)).drop("_n")


def request_batches(selected: DataFrame, size: int = DEFAULTS.override_batch_rows, seq: str = "review_seq") -> DataFrame:
    """One JSON payload per batch; a batch never holds more than `size` rows."""
    entry = F.struct(F.col(seq).alias("row"), text.text_or_empty(F.col("review_text")).alias("review"))
    return (
        numbered_batches(selected, size, seq)
        .groupBy("batch")
        .agg(F.count("*").alias("rows"), F.to_json(F.sort_array(F.collect_list(entry))).alias("payload"))
    )


def parse_responses(responses: DataFrame, column: str = "response") -> DataFrame:
    """(batch, response) to parsed rows; `parsed` is null where the text is no JSON list."""
    bare = F.regexp_replace(text.strip(F.col(column)), r"^```json|```$", "")
    return responses.withColumn("parsed", F.from_json(bare, RESPONSE_SCHEMA)).drop(column)


def decisions(parsed: DataFrame) -> DataFrame:
    """One row per (batch, row): the last entry of a batch wins."""
    return (
        parsed.select("batch", F.posexplode("parsed").alias("position", "item"))
        .select("batch", "position", F.col("item.row").alias("row"), F.col("item.category").alias("category"))
        .filter(F.col("row").isNotNull())
    )


def accepted(decided: DataFrame, batches: DataFrame, seq: str = "review_seq", labels=CATEGORY_LABELS) -> DataFrame:
    """Keep rows of the own batch with a known label; the last one per row counts."""
    asked = batches.select("batch", F.col(seq).alias("row"))
    return (
        decided.filter(F.col("category").isin(*labels))
        .join(asked, ["batch", "row"], "left_semi")
        .groupBy("row")
        .agg(F.max_by("category", "position").alias("new_category"))
    )


def apply_overrides(df: DataFrame, labels: DataFrame, seq: str = "review_seq") -> DataFrame:
    """(row, new_category) onto the reviews; resolved rows leave the queue."""
    joined = df.join(labels.withColumnRenamed("row", seq), seq, "left")
    hit = F.col("new_category").isNotNull()
    updates = {
        "category": F.coalesce("new_category", "category"),
        "prediction_confidence": F.when(hit, 1.0).otherwise(F.col("prediction_confidence")),
        "needs_human_review": F.when(hit, False).otherwise(F.col("needs_human_review")),
        "requires_llm_review": F.when(hit, False).otherwise(F.col("requires_llm_review")),
        "review_route": F.when(hit, "llm_resolved").otherwise(F.col("review_route")),
        "classification_source": F.when(hit, "llm_review").otherwise(F.col("classification_source")),
    }
    return joined.withColumns(updates).drop("new_category").select(*df.columns)


def resolve_ambiguous(df: DataFrame, responses: DataFrame, size: int = DEFAULTS.override_batch_rows, seq: str = "review_seq") -> DataFrame:
    """Apply responses only when every batch has one that parses; otherwise change nothing."""
    batches = numbered_batches(ambiguous_reviews(df), size, seq).select("batch", seq)
    parsed = parse_responses(responses)
    asked = batches.select("batch").distinct()
    open_batches = asked.join(parsed.filter(F.col("parsed").isNotNull()), "batch", "left_anti")
    broken = parsed.join(asked, "batch", "left_semi").filter(F.col("parsed").isNull()).select("batch")
    failures = open_batches.unionByName(broken).agg(F.count("*").alias("n")).scalar()
    labels = accepted(decisions(parsed), batches, seq).filter(failures == 0)
    return apply_overrides(df, labels, seq)
