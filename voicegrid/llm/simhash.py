"""SimHash near-duplicates, found with BK-trees.

Fingerprints: 64-bit SimHash over hashed word shingles. Links: two fingerprints with at
most `radius` different bits. A pair within the radius agrees on at least one of radius + 1 groups of bits,
so fingerprints are dealt into shards by each group's value, and no link is lost. A shard above `cap`
members is dealt again by groups of its remaining bits, again without a loss. In every shard a BK-tree
(children keyed by the Hamming distance to their parent) is queried with each member, following only edges
within the radius. The trees travel by shuffle: fingerprints of all documents must not pass the driver.

A shard gives each linked member's lowest fellow, not all pairs; connected components of these links
are those of all links. Rows with equal fingerprints are one node. Null texts count as empty (fingerprint zero,
which links like any other). A null id takes part, but is never a component's id unless all ids are null.
Repeated rows are kept, an empty table gives an empty result, other columns are ignored unless named in `carry`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voicegrid.llm.common import SMALL_ROWS, lookup_left
from voicegrid.operators.components import connected_components
from voicegrid.session import materialize

BITS = 64
SHINGLE_WORDS = 4
RADIUS = 4
TREE_CAP = 2000
_SLICE = 1 << 16


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of UTF-8 bytes: A-Z lower-cased, words split at ASCII white space.

    A bit is set if it is set in more than half of the shingle hashes (XXH64, seed 42).
    """
    tokens = text.lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]).tolist()
    starts = [0, *ends[:-1]]
    width = min(words, len(tokens)) - 1
    digest = xxhash.xxh64_intdigest
    ones, total = np.zeros(BITS, dtype=np.int64), len(tokens) - width
    for at in range(0, total, _SLICE):
        stop = min(total, at + _SLICE)
        hashes = np.array(
            [digest(line[a:b - 1], 42) for a, b in zip(starts[at:stop], ends[at + width:stop + width])], dtype="<u8"
        )
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > total, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str, text: str, carry: Sequence[str], words: int) -> DataFrame:
    """(doc_id, carry..., fp), the fingerprint as a signed bigint."""
    rows = docs.select(F.col(id_column).alias("doc_id"), *carry, F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_bytes"))
    schema = rows.drop("_bytes").schema.add("fp", T.LongType())

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(part.num_columns - 1)
            values = np.array([fingerprint(x.as_py(), words) for x in texts], dtype="<u8").view("<i8")
            columns = [part.column(i) for i in range(part.num_columns - 1)] + [pa.array(values)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(batches, schema)


def child_masks(mask: int, radius: int) -> list[int]:
    """`mask` widened by each of radius + 1 runs of its free bits; none left to split gives no child."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    if len(free) <= radius:
        return []
    return [mask | sum(1 << int(i) for i in run) for run in np.array_split(free, radius + 1)]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def shards(codes: DataFrame, radius: int, cap: int = TREE_CAP, small: int = SMALL_ROWS) -> DataFrame:
    """(fp, mask, code): every fingerprint in the shards where its partners can be.

    Shard sizes are counted before any row moves; members of shards above `cap` go to the shards of the next
    level instead.
    """
    if cap < 1 << radius:
        raise ValueError("a shard that can't be dealt again holds up to 2^radius fingerprints")
    spark, mask64 = codes.sparkSession, (1 << BITS) - 1
    first = F.array(*[F.lit(_signed(m)) for m in child_masks(0, radius)])
    rows = codes.select("fp", F.explode(first).alias("mask")).withColumn("code", F.col("fp").bitwiseAND(F.col("mask")))
    done = None
    while True:
        large = rows.groupBy("mask", "code").agg(F.count("*").alias("members")).filter(F.col("members") > cap)
        large = materialize(large.select("mask", "code"), "large-shards")
        count = large.count()
        if count == 0:
            return rows if done is None else done.unionByName(rows)
        known = F.broadcast(large) if count <= small else large
        settled = rows.join(known, ["mask", "code"], "left_anti")
        done = settled if done is None else done.unionByName(settled)
        # A level has at most (radius + 1) times the masks of the one above, whatever the input.
        masks = [r["mask"] for r in large.select("mask").distinct().collect()]
        steps = spark.createDataFrame(
            [(m, _signed(c)) for m in masks for c in child_masks(m & mask64, radius)], "mask bigint, child bigint"
        )
        rows = materialize(
            rows.join(known, ["mask", "code"], "left_semi").join(F.broadcast(steps), "mask")
            .select("fp", F.col("child").alias("mask"), F.col("fp").bitwiseAND(F.col("child")).alias("code")),
            "shard-rows",
        )


def tree_links(members: Sequence[int], radius: int) -> list[tuple[int, int]]:
    """Star links (member, lowest fellow) of one shard, by a BK-tree over its distinct members."""
    if len(members) < 2:
        return []
    root, children, parent = members[0], {members[0]: {}}, {}

    def top(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for x in members[1:]:
        if x in children:
            continue
        todo = [root]
        while todo:
            node = todo.pop()
            d = (x ^ node).bit_count()
            if d <= radius:
                a, b = top(x), top(node)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            low, high = d - radius, d + radius
            todo += [kid for edge, kid in children[node].items() if low <= edge <= high]
        node = root
        while (kid := children[node].get(d := (x ^ node).bit_count())) is not None:
            node = kid
        children[node][d] = x
        children[x] = {}
    return [(x, t) for x in members if (t := top(x)) != x]


def links(dealt: DataFrame, radius: int) -> DataFrame:
    """(a, b) links inside all shards; a task goes through its shards one after the other."""
    mask64 = (1 << BITS) - 1

    def walk(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, members = None, []
        for part in parts:
            fps, masks, codes = (part.column(i).to_pylist() for i in range(3))
            found: list[tuple[int, int]] = []
            for fp, *key in zip(fps, masks, codes):
                if key != shard:
                    found += tree_links(members, radius)
                    shard, members = key, []
                members.append(fp & mask64)
            yield _batch(found)
        yield _batch(tree_links(members, radius))

    placed = dealt.repartition("mask", "code").sortWithinPartitions("mask", "code")
    return placed.select("fp", "mask", "code").mapInArrow(walk, "a bigint, b bigint")


def _batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(found, dtype="<u8").reshape(-1, 2).view("<i8")
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", carry: Sequence[str] = (),
    words: int = SHINGLE_WORDS, radius: int = RADIUS, cap: int = TREE_CAP, small: int = SMALL_ROWS, group: str | None = None,
) -> DataFrame:
    """One row per document: doc_id, (carry,) fingerprint (16 hex digits), component_id (smallest id reachable).

    With `group`, a column of that name tells the groups apart, those without any id too.
    """
    rows = materialize(fingerprints(docs, id_column, text, carry, words), "fingerprints")
    nodes = materialize(
        rows.groupBy("fp").agg(F.count("*").alias("held"), F.min("doc_id").alias("lowest")), "fingerprint-nodes"
    )
    found = materialize(links(shards(nodes.select("fp"), radius, cap, small), radius), "fingerprint-links")
    member = connected_components(found).select(F.col("node").alias("fp"), F.col("component").alias("group"))
    member = materialize(member, "fingerprint-groups")
    # Only fingerprints that several rows share or that are linked need a lookup.
    tied = nodes.join(member, "fp", "left").filter("held > 1 OR group IS NOT NULL")
    tied = materialize(tied.withColumn("group", F.coalesce("group", "fp")), "fingerprint-tied")
    lowest = materialize(tied.groupBy("group").agg(F.min("lowest").alias("component"), F.count("*").alias("nodes")), "groups")
    entries = materialize(
        lookup_left(tied.select("fp", "group", "held"), lowest, ["group"], "nodes", small).select(
            "fp", "held", "component", "group", F.lit(True).alias("listed")
        ),
        "fingerprint-entries",
    )
    joined = lookup_left(rows, entries, ["fp"], "held", small)
    return joined.select(
        "doc_id", *carry,
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("listed"), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        *([F.coalesce("group", "fp").alias(group)] if group else []),
    )
