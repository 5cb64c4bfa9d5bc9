"""Mixing of sources to target weights by systematic sampling.

Targets. Sources weigh 5, 2, 1 and so on in the order of their names and share a multiple of all words. A target above `most`
times its source's words stops there, and the excess is shared again by weight, until none is above. Every such round
is one sum over the table of sources.

Sampling. A document of a source is expected target / source words times. The expected copies are summed up over the source's
documents, from long to short; one random offset is added, and a document is emitted once per integer boundary its share
crosses. Copies are counted in units of 1 / 2^24, so the sums are exact in any order of adding and a rerun gives the same
rows. As neighbours have about one length, what is taken differs from the target by less than the longest document's words; of
`DRAWS` random offsets the one nearest to the target is used, which makes that small.

The prefix sums run over ranges of rows cut at sampled quantiles: each range is summed up by itself and shifted by the
ranges before it, so no task holds a whole source. Texts are read once, and counted words and ids are all that is shuffled.

Edge cases. A null or blank text has size 0; it is expected as often as others, and takes no words. A null source is a source
of its own, after all others. A source without words has target 0 and takes nothing. Documents without id and rows that repeat one are
sampled like any other; among equal sizes the smaller id comes first, null ids at the end. An empty table gives an empty result.
Other columns are ignored, whatever their names; `mixed` returns them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicegrid.llm.common import free_name, lookup_left, with_row_id
from voicegrid.operators.skew import running_sums
from voicegrid.session import materialize

WEIGHTS = (5, 2, 1)
# Words of the mix as a fraction of all words; no source is taken more often than MOST times.
SHARE = (3, 2)
MOST = 2
DRAWS = 16
SEED = "mix-1"
UNIT_BITS = 24
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", carry: Sequence[str] = ()) -> DataFrame:
    """Stored (doc_id, key, size, ...): number of words, and the source as a key that is never null and orders like the source."""
    words = F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD)).cast("bigint")
    name = F.col(source).cast("string")
    key = F.when(name.isNull(), "1").otherwise(F.concat(F.lit("0"), name))
    kept = [F.col(c) for c in carry]
    return materialize(docs.select(F.col(id_column).alias("doc_id"), key.alias("key"), words.alias("size"), *kept), "mix-sizes")


def targets(
    sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST
) -> DataFrame:
    """Stored (key, docs, source_size, weight, target) with one row per source."""
    sources = materialize(sized.groupBy("key").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size")), "mix-sources")
    placed = running_sums(sources.withColumn("one", F.lit(1).cast("bigint")), [], ["key"], "one", "at")
    listed = F.array(*[F.lit(w) for w in weights])
    weighed = materialize(placed.select(
        "key", "docs", "source_size", F.get(listed, F.pmod("at", F.lit(len(weights))).cast("int")).cast("bigint").alias("weight")
    ), "mix-weights")
    cap, level = F.col("source_size") * most, 0.0
    # Exact sums of whole numbers; the level rises until no further source reaches its cap below it.
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    stopped = -1
    while True:
        full = cap <= F.lit(level) * F.col("weight")
        count, held, open_weight = weighed.agg(
            F.count_if(full), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if count == stopped or not open_weight:
            break
        stopped, level = count, (share[0] * total / share[1] - (held or 0)) / open_weight
    return weighed.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("weight")))


def offsets(key: Column, draws: int = DRAWS, seed: str = SEED) -> Column:
    """Random offsets of a source, in units."""
    drawn = [F.md5(F.concat(F.lit(f"{seed}:{n}:"), key).cast("binary")) for n in range(draws)]
    return F.array(*[F.conv(F.substring(d, 1, UNIT_BITS // 4), 16, 10).cast("bigint") for d in drawn])


def copies(before: Column, expected: Column, offset: Column) -> Column:
    """Integer boundaries between the shifted sums before and behind a document."""
    return F.shiftright(before + expected + offset, UNIT_BITS) - F.shiftright(before + offset, UNIT_BITS)


def sample(
    sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST,
    draws: int = DRAWS, seed: str = SEED,
) -> DataFrame:
    """Rows of `sized` with source_size, target, and how many copies the mix takes of the document."""
    found = targets(sized, weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    expected = F.floor(rate * float(1 << UNIT_BITS) + 0.5)
    sources = materialize(found.select("key", "docs", "source_size", "target", expected.alias("expected")), "mix-targets")
    rows = lookup_left(sized, sources, ["key"], "docs")
    order = [F.desc("size"), F.asc_nulls_last("doc_id")]
    summed = materialize(running_sums(rows.drop("docs"), ["key"], order, "expected", "before"), "mix-sums")
    tried = [
        F.sum(copies(F.col("before"), F.col("expected"), F.get(offsets(F.col("key"), draws, seed), F.lit(n))) * F.col("size"))
        for n in range(draws)
    ]
    # One row per source: how far each offset's words are from the target.
    taken = summed.groupBy("key").agg(
        F.count("*").alias("docs"), F.first("target").alias("target"), F.array(*tried).alias("taken")
    )
    away = F.transform("taken", lambda t, n: F.struct(F.abs(t - F.col("target")).alias("off"), n.alias("n")))
    best = F.get(offsets(F.col("key"), draws, seed), F.array_min(away)["n"])
    chosen = materialize(taken.select("key", "docs", best.alias("offset")), "mix-offsets")
    return lookup_left(summed, chosen, ["key"], "docs").withColumn(
        "copies", copies(F.col("before"), F.col("expected"), F.col("offset"))
    ).drop("docs", "expected", "before", "offset", "key")


def plan(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """(doc_id, size, source_size, target, taken): the words the mix takes of every document."""
    found = sample(sizes(docs, id_column, text, source), **settings)
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """The mix itself: the rows of `docs`, each as often as it is taken, with `copy` counting from 1 (or the next free name)."""
    row = free_name(docs, "_row")
    numbered = with_row_id(docs, row)
    taken = sample(sizes(numbered, id_column, text, source, carry=[row]), **settings).filter("copies > 0")
    copy = free_name(docs, "copy")
    joined = numbered.join(taken.select(row, F.col("copies").alias(copy)), row)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("bigint"), copy))).select(*docs.columns, copy)
