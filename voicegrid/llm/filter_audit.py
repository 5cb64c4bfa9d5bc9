"""Audit of the order in which document filters are applied.

Every document gets a mask with one bit per filter it fails, and masks are counted per part: a few cells, whatever the
number of documents. A recursive common table expression starts from the mask cells with an empty prefix, extends
every prefix by each unused letter and carries the bits applied so far, so each level of the recursion gives, for
a step, which cells it keeps, removes, finds removed already or alone removes. Its rows depend on the number of filters only (325
prefixes and 32 masks for five), so the result is broadcast to the counted cells. What a filter removes after
a prefix of k letters occurs in (n - k - 1)! orders; their sum over prefixes is the filter's total over all orders.

Texts are read once. Copies are found by the SHA-256 of the text, counted before they are shuffled; a digest that many
documents share is joined by broadcast.

Edge cases. A null text is empty: no words, so it has no repeated words and no capitals. A null part is the empty string. A copy
is a document whose text occurs with a smaller id; rows that repeat the smallest id are all originals, and a row without id is
never a copy. A document counts as good or toxic if any of its label rows says so, once; label rows without id are
ignored. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voicegrid.llm.common import lookup_left
from voicegrid.session import materialize

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SIGNS = 50, 65, 5, "[#$%&*|]"
# The letter of the filter that drops copies; the others look at one document alone.
COPIES = "E"

METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """Failure condition of each filter that looks at one document; `words` is the array of its words."""
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > CAPITAL_PERCENT * F.length(text),
        "D": text.rlike(SIGNS),
    }


def masks(
    docs: DataFrame, filters: Callable[[Column, Column], Mapping[str, Column]] = text_filters,
    id_column: str = "doc_id", text: str = "text", part: str = "source",
) -> DataFrame:
    """(doc_id, part, mask) of every row; bit k stands for the k-th letter, the last one for copies."""
    stated = docs.select(
        F.col(id_column).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    split = stated.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != ""))
    failed = filters(F.col("text"), F.col("words"))
    bits = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failed.values())), F.lit(0))
    facts = materialize(
        split.select("doc_id", "part", bits.alias("mask"), F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest")),
        "audit-facts",
    )
    firsts = facts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("held")).filter("held > 1")
    copied = lookup_left(facts, materialize(firsts, "audit-copies"), ["digest"], "held")
    copy = F.when(F.col("doc_id") > F.col("first"), 1 << len(failed)).otherwise(0)
    return copied.select("doc_id", "part", F.col("mask").bitwiseOR(copy).alias("mask"))


def cells(masked: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(part, mask, docs, good, toxic): documents, and those labelled so, per cell."""
    said = labels.filter(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    # Counted by id first: rows that repeat an id, or have none, come to the join as a few counts.
    counted = masked.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("docs"))
    return counted.join(said, "doc_id", "left").groupBy("part", "mask").agg(
        F.sum("docs").alias("docs"),
        F.sum(F.when(F.col("good") == 1, F.col("docs")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic") == 1, F.col("docs")).otherwise(0)).alias("toxic"),
    )


def steps(spark: SparkSession, found: DataFrame, letters: Sequence[str]) -> DataFrame:
    """(prefix, step, letter, mask) with what the last filter of the prefix does to the mask's cells, as 0 or 1.

    `found` has the masks that occur, one row each.
    """
    listed = ", ".join(f"named_struct('letter', '{x}', 'bit', {1 << k})" for k, x in enumerate(letters))
    return spark.sql(
        f"""WITH RECURSIVE walk(prefix, step, applied, letter, mask, kept, removed, redundant, unique_fails) AS (
          SELECT '', 0, 0, '', mask, 1, 0, 0, 0 FROM {{cells}}
          UNION ALL
          SELECT concat(prefix, next.letter), step + 1, applied | next.bit, next.letter, mask,
            int(mask & (applied | next.bit) = 0),
            int(mask & next.bit <> 0 AND mask & applied = 0),
            int(mask & next.bit <> 0 AND mask & applied <> 0),
            int(mask = next.bit)
          FROM walk LATERAL VIEW explode(filter(array({listed}), f -> applied & f.bit = 0)) unused AS next)
        SELECT prefix, step, letter, mask, kept, removed, redundant, unique_fails FROM walk WHERE step > 0""",
        cells=found,
    )


def audit(
    docs: DataFrame, labels: DataFrame, filters: Callable[[Column, Column], Mapping[str, Column]] = text_filters,
    copies: str = COPIES, id_column: str = "doc_id", text: str = "text", part: str = "source",
) -> DataFrame:
    """(part, filter_order, step, kept, ..., toxic_lost, shapley) for every part, order of the filters and step."""
    spark = docs.sparkSession
    letters = [*filters(F.lit(""), F.array(F.lit(""))), copies]
    counted = materialize(cells(masks(docs, filters, id_column, text, part), labels, id_column), "audit-cells")
    walk = materialize(steps(spark, counted.select("mask").distinct(), letters), "audit-steps")
    flagged = counted.join(F.broadcast(walk), "mask").groupBy("part", "prefix", "step", "letter").agg(
        *[F.sum(F.col(m) * F.col("docs")).alias(m) for m in METRICS[:4]],
        F.sum(F.col("removed") * F.col("good")).alias("good_lost"),
        F.sum(F.col("removed") * F.col("toxic")).alias("toxic_lost"),
    )
    orders = F.element_at(F.array(*[F.lit(math.factorial(len(letters) - k)) for k in range(1, len(letters) + 1)]), F.col("step"))
    # At most 65 prefixes end in one letter, in every part.
    valued = flagged.withColumn("shapley", F.sum(F.col("removed") * orders).over(W.partitionBy("part", "letter")))
    whole = walk.filter(F.col("step") == len(letters)).select(F.col("prefix").alias("filter_order")).distinct()
    placed = whole.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    placed = placed.withColumn("prefix", F.col("filter_order").substr(F.lit(1), F.col("step")))
    return valued.join(F.broadcast(placed), ["prefix", "step"]).select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        *[F.col(m).cast("bigint").alias(m) for m in METRICS], F.col("shapley").cast("bigint").alias("shapley"),
    )
