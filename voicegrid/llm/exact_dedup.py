"""Exact dedup by an extendible-hash index kept as files in the shared folder. DataFrame functions only.

A text's key is a 64-bit hash of its normalised form. The directory doubles level by level:
a bucket is a key prefix of d bits, and every bucket above its capacity is split on the next
bit. Keys carried by one row need no comparison. For the others the texts themselves are
grouped, copies first inside each map task, and the owner task of a bucket's key range chains the
different texts that share a key. Index pages are written sorted, one key range per task.

Nulls count as empty texts, also null ids (last in the order of ids). Of repeated rows with one
id and one text, one stays. An empty table gives an empty result. Other columns are ignored
unless named in `carry`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voicegrid.llm.common import SMALL_ROWS, lookup_left
from voicegrid.session import materialize

SPACES = r"[\x20\x09-\x0D]+"
BUCKET_KEYS = 50_000
DIRECTORY_BITS = 20


def normalised(text: Column) -> Column:
    """Every run of white space becomes one space."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ")


def directory(keys: DataFrame, capacity: int = BUCKET_KEYS, max_bits: int = DIRECTORY_BITS) -> tuple[DataFrame, int]:
    """Directory (slot, bucket, depth) over the top bits of `keys.key`, and its number of bits.

    Level d holds the prefixes of d bits; going down one level doubles the directory. A
    bucket is the first prefix with at most `capacity` keys. At `max_bits` an overfull bucket stays
    whole, as an overflow page. The directory has at most 2^max_bits rows, whatever the input.
    """
    wanted = keys.count() // capacity
    bits = min(max_bits, wanted.bit_length() + 4)
    slots = keys.groupBy(F.shiftrightunsigned("key", 64 - bits).alias("slot")).agg(F.count("*").alias("keys"))
    levels = (
        slots.select("slot", "keys", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
        .groupBy("depth", F.expr(f"shiftrightunsigned(slot, {bits} - depth)").alias("prefix"))
        .agg(F.sum("keys").alias("keys"))
    )
    overfull = levels.filter(F.col("keys") > capacity).select(
        (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above")
    )
    buckets = (
        levels.withColumn("above", F.shiftrightunsigned("prefix", 1))
        .join(overfull, ["depth", "above"], "left_semi")
        .unionByName(levels.filter("depth = 0").withColumn("above", F.lit(0).cast("bigint")))
        .filter((F.col("keys") <= capacity) | (F.col("depth") == bits))
    )
    first = F.expr(f"shiftleft(prefix, {bits} - depth)")
    last = F.expr(f"shiftleft(prefix + 1, {bits} - depth) - 1")
    return buckets.select(F.explode(F.sequence(first, last)).alias("slot"), first.alias("bucket"), "depth"), bits


def build_index(
    rows: DataFrame, texts: DataFrame, capacity: int = BUCKET_KEYS, max_bits: int = DIRECTORY_BITS, small: int = SMALL_ROWS
) -> DataFrame:
    """Index pages (bucket, depth, key, chain, text_sha256, size, keep_id, keep_row) of all texts held more than once.

    `rows` is the stored narrow table (doc_id, key, text_sha256, row), `texts` gives (key, norm). Texts
    that one row holds are not listed: such a row is its own group.
    """
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    keys = materialize(rows.groupBy("key").agg(F.count("*").alias("held")), "dedup-keys")
    contested = keys.filter("held > 1")
    # Winner of each digest, narrow; the text itself decides below which rows are equal.
    winners = (
        rows.groupBy("key", "text_sha256").agg(F.count("*").alias("size"), F.min(order).alias("keep"))
        .filter("size > 1")
    )
    count = contested.count()
    shared = texts.join(F.broadcast(contested.select("key")) if count <= small else contested.select("key"), "key", "left_semi")
    chains = materialize(shared.groupBy("key", "norm").agg(F.count("*").alias("held")), "dedup-chains")
    slots, bits = directory(contested, capacity, max_bits)
    # Each owner task holds a range of buckets and puts the different texts of a key in a chain.
    owned = (
        chains.withColumn("slot", F.shiftrightunsigned("key", 64 - bits))
        .join(F.broadcast(slots), "slot")
        .repartitionByRange("bucket", "key")
        .withColumn("chain", F.row_number().over(W.partitionBy("bucket", "key").orderBy("norm")))
        .filter("held > 1")
        .select("bucket", "depth", "key", "chain", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "held")
    )
    found = owned.join(winners, ["key", "text_sha256"])
    same = F.when(F.col("held") == F.col("size"), F.col("size")).otherwise(
        F.raise_error("two different texts share key and SHA-256").cast("bigint")
    )
    pages = found.select(
        "bucket", "depth", "key", "chain", "text_sha256", same.alias("size"),
        F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row"),
    )
    return materialize(pages.sortWithinPartitions("bucket", "key", "chain"), "dedup-index")


def exact_dedup(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", carry: Sequence[str] = (),
    key: Callable[[Column], Column] = F.xxhash64, capacity: int = BUCKET_KEYS,
    max_bits: int = DIRECTORY_BITS, small: int = SMALL_ROWS,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (and `carry`).

    `key` is the 64-bit hash; whatever it is, only equal texts are put together.
    """
    texts = docs.select(F.col(id_column).alias("doc_id"), *carry, normalised(F.col(text)).alias("norm"))
    keyed = texts.withColumn("key", key(F.col("norm")).cast("bigint"))
    rows = materialize(
        keyed.select(
            "doc_id", *carry, "key", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "dedup-rows",
    )
    index = build_index(rows, keyed.select("key", "norm"), capacity, max_bits, small)
    entries = index.select("key", "text_sha256", "size", "keep_id", "keep_row")
    alone = F.col("size").isNull()
    return lookup_left(rows, entries, ["key", "text_sha256"], "size", small).select(
        "doc_id", *carry,
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )
