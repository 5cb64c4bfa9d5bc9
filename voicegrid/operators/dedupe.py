"""Near-duplicate groups: reviews whose TF-IDF cosine reaches a threshold, transitively.

Shape of the job
  1. Rows with the same token sequence collapse to one unit (map-side combine
     absorbs a text that makes up a third of the table).
  2. Terms are ordered rare to frequent. Two units at cosine >= t share a term of
     both prefixes, where a prefix ends once the rest of the vector is shorter
     than t (Bayardo et al., WWW 2007). Units meet in (app, prefix term) blocks.
  3. Every block links its members to its first member: one candidate per member,
     so a block of near copies costs as many checks as it has members.
  4. Members of one resulting component need no more checks. What is left, pairs
     of different components in a block, is cut by two exact bounds: the norms of
     the vectors from the shared term on, and the angles to the first member.
  5. Components of both kinds of links are the groups.

No pair of a group of (near) copies is listed, none that matters is skipped.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voicegrid.config import DEFAULTS
from voicegrid.functions import text, vectors
from voicegrid.operators.components import connected_components
from voicegrid.operators.features import idf
from voicegrid.operators.skew import HOT_KEYS, dealt_cells, join_frequent, number_rows
from voicegrid.operators.term_blocks import shared_terms
from voicegrid.session import materialize, materialize_parts, spread

# Bound of whole vectors that may be broadcast.
HOT_VECTORS = 200
# Pairs in one turn, as a multiple of the units, and at least: every pair carries a vector through the shuffle.
TURN_PAIRS, LEAST_PAIRS = 0.5, 8_000
# Two values a band find pairs that share two fifths of their terms in 98 of 100 cases.
MINHASH_BANDS, MINHASH_ROWS = 24, 2
# Cosines are compared with this slack, as sums differ in their last digits.
SLACK = 1e-9


def with_unit(reviews: DataFrame, seq: str = "review_seq") -> DataFrame:
    """`tokens`: the token sequence as text; rows without tokens stay apart by their number."""
    tokens = F.array_join(text.vector_tokens(F.col("review_text")), " ")
    return reviews.withColumn(
        "tokens", text.once(tokens, lambda t: F.when(t == "", F.concat(F.lit("#"), F.col(seq).cast("string"))).otherwise(t))
    )


def unit_digest(tokens):
    return F.sha2(tokens, 256)


def collapse_copies(reviews: DataFrame, seq: str = "review_seq") -> DataFrame:
    """One row per (app, token sequence): first row number and number of copies."""
    return (
        with_unit(spread(reviews.select("app_id", seq, "review_text")), seq)
        .groupBy("app_id", "tokens")
        .agg(F.min(seq).alias("unit"), F.count("*").alias("copies"))
    )


def app_sizes(units: DataFrame) -> DataFrame:
    return units.groupBy("app_id").agg(F.sum("copies").alias("app_rows"))


def unit_vectors(units: DataFrame, threshold: float = DEFAULTS.dedupe_threshold, only_pairable: bool = False) -> DataFrame:
    """Per unit its shared terms with unit-length weights, and its prefix.

    Most terms (rare word pairs above all) occur in one unit only. They count in
    the length of a vector but never in a product, so only their squares are kept.
    In the global term order they come first, then shared terms by document frequency.
    `prefix` holds the shared prefix terms and, for each, the squared length of
    the vector from that term on (`rest`); `mass` is the squared length of all shared terms. What is returned reads a stored table of counts
    (a third of the size of the weights), so it need not be stored again. `units` has to be stored.
    With `only_pairable`, units that can't have a partner are left out, as `similarity_links` does anyway.
    """
    worded = units.filter(~F.startswith("tokens", F.lit("#")))
    sizes = materialize(app_sizes(units), "app-sizes")
    sized = join_frequent(worded, sizes, ["app_id"], "app_rows", stored=True)
    # Units are numbered inside their tasks, so rows have to come in one order if a task is repeated: after a shuffle they don't.
    if sizes.count() > HOT_KEYS:
        sized = materialize(sized, "sized-units")
    packed = shared_terms(sized, threshold, SLACK, _least_mass(threshold) if only_pairable else 0.0)
    weight = lambda t: F.struct(
        t["k1"].cast("bigint").alias("k1"), t["k2"].cast("bigint").alias("k2"),
        (t["tf"] * idf(t["df"], F.col("app_rows")) / F.sqrt("squares")).alias("w"),
    )
    before = F.size("terms") - F.size("rests")
    placed = F.zip_with(
        F.slice("terms", before + 1, F.size("rests")), "rests",
        lambda t, rest: F.struct(t["k1"].cast("bigint").alias("k1"), t["k2"].cast("bigint").alias("k2"), rest.alias("rest")),
    )
    return packed.select("unit", F.transform("terms", weight).alias("vector"), placed.alias("prefix"), "mass")


def _least_mass(threshold: float) -> float:
    return threshold * threshold - SLACK


def pairable(units: DataFrame, threshold: float) -> DataFrame:
    """Units that can have a partner: a cosine is no more than the length of either vector's shared part."""
    return units.filter(F.col("mass") >= _least_mass(threshold))


def with_cosine(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """Add the exact cosine to distinct, stored (a, b) unit pairs.

    Many more pairs than units take turns, so what is on disk at one time grows with the units, not with the pairs.
    """
    turns = math.ceil(pairs.count() / max(TURN_PAIRS * units.count(), LEAST_PAIRS))
    if turns < 2:
        return _with_cosine(pairs, units)
    turn = F.pmod(F.xxhash64("b"), F.lit(turns))
    return materialize_parts([_with_cosine(pairs.filter(turn == n), units) for n in range(turns)], "cosines")


def _with_cosine(pairs: DataFrame, units: DataFrame) -> DataFrame:
    both = pairs
    for end, vector in (("b", "right_vector"), ("a", "left_vector")):
        used = materialize(pairs.groupBy(end).agg(F.count("*").alias("uses"), F.lit(1).alias("units")), "used")
        # Few units are in any pair: vectors of the others are dropped where they are read.
        side = join_frequent(units.select(F.col("unit").alias(end), F.col("vector").alias(vector)), used, [end], "units", stored=True).drop("units")
        # Vectors are read again from the stored units rather than stored once more in each turn.
        both = join_frequent(both, side, [end], "uses", hot_keys=HOT_VECTORS, counts=used, stored=True).drop("uses")
    return both.withColumn("cosine", vectors.sparse_dot(F.col("left_vector"), F.col("right_vector"))).drop(
        "left_vector", "right_vector"
    )


def similarity_links(units: DataFrame, threshold: float = DEFAULTS.dedupe_threshold) -> DataFrame:
    """(a, b, cosine) links at or above the threshold that connect every near-duplicate group.

    `units` is the stored output of `unit_vectors`.
    """
    units = pairable(units, threshold)
    blocks = materialize(units.select("unit", F.inline("prefix")), "prefixes")
    heads = (
        blocks.groupBy("k1", "k2")
        .agg(F.min("unit").alias("head"), F.count("*").alias("members"))
        .filter("members > 1")
    )
    headed = join_frequent(blocks, heads, ["k1", "k2"], "members")
    spokes = headed.filter("unit <> head").select(F.col("head").alias("a"), F.col("unit").alias("b")).distinct()
    spokes = materialize(spokes, "spoke-pairs")
    measured = materialize(with_cosine(spokes, units), "spokes")
    near = measured.filter(F.col("cosine") >= threshold - SLACK)
    first = connected_components(near)

    # Blocks whose members are not yet all in one component.
    angle = F.acos(F.greatest(F.least("cosine", F.lit(1.0)), F.lit(0.0)))
    angles = measured.select(F.col("a").alias("head"), F.col("b").alias("unit"), angle.alias("angle"))
    placed = (
        headed.join(angles, ["head", "unit"], "left")
        .withColumn("angle", F.coalesce("angle", F.lit(0.0)))
        .join(first.withColumnRenamed("node", "unit"), "unit", "left")
        .withColumn("component", F.coalesce("component", "unit"))
    )
    placed = materialize(placed.select("k1", "k2", "unit", "rest", "angle", "component"), "blocks")
    mixed = (
        placed.groupBy("k1", "k2")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members"))
        .filter("lo <> hi")
    )
    open_rows = join_frequent(placed, mixed.select("k1", "k2", "members"), ["k1", "k2"], "members")
    reach = math.acos(threshold - SLACK) + SLACK
    binned = open_rows.withColumn("bin", F.floor(F.col("angle") / reach))
    left = binned.select("k1", "k2", "bin", *[F.col(c).alias("l_" + c) for c in ("unit", "rest", "angle", "component")])
    right = binned.select(
        "k1", "k2", F.explode(F.sequence(F.col("bin") - 1, F.col("bin") + 1)).alias("bin"),
        *[F.col(c).alias("r_" + c) for c in ("unit", "rest", "angle", "component")],
    )
    # A block of many members is dealt out in cells of pairs.
    left, right, cell = dealt_cells(left, right, ["k1", "k2", "bin"])
    candidates = (
        left.join(right, cell)
        .filter("l_unit < r_unit AND l_component <> r_component")
        .filter(F.col("l_rest") * F.col("r_rest") >= (threshold - SLACK) ** 2)
        .filter(F.abs(F.col("l_angle") - F.col("r_angle")) <= reach)
        .select(F.col("l_unit").alias("a"), F.col("r_unit").alias("b"))
        .distinct()
    )
    bridges = with_cosine(materialize(candidates, "bridge-pairs"), units).filter(F.col("cosine") >= threshold - SLACK)
    return near.unionByName(bridges)


def minhash_links(
    units: DataFrame, threshold: float = DEFAULTS.dedupe_threshold, bands: int = MINHASH_BANDS, rows: int = MINHASH_ROWS
) -> DataFrame:
    """Like `similarity_links`, but approximate: candidates share a band of MinHash values of their terms.

    Every (band, values) block links its members to its first one and to the next one in the order of another hash, so
    candidates grow with units x bands, not with pairs. Links are verified by the exact cosine, so
    none is wrong; some can be missing.
    """
    units = pairable(units, threshold)
    terms = units.select("unit", F.explode("vector").alias("t")).select("unit", F.xxhash64("t.k1", "t.k2").alias("k"))
    hashed = [F.min(F.xxhash64("k", F.lit(n))).alias(f"h{n}") for n in range(bands * rows)]
    signatures = terms.groupBy("unit").agg(*hashed)
    keys = [F.struct(F.lit(b).alias("band"), F.xxhash64(*[f"h{b * rows + r}" for r in range(rows)]).alias("key")) for b in range(bands)]
    blocks = materialize(signatures.select("unit", F.inline(F.array(*keys))), "bands")
    heads = blocks.groupBy("band", "key").agg(F.min("unit").alias("head"), F.count("*").alias("members")).filter("members > 1")
    headed = join_frequent(blocks, heads, ["band", "key"], "members")
    spokes = headed.filter("unit <> head").select(F.col("head").alias("a"), F.col("unit").alias("b"))
    # Neighbours inside slices of a block: a frequent block is not sorted by one task.
    mixed = F.xxhash64("unit", F.lit("next"))
    near = W.partitionBy("band", "key", F.pmod(mixed, F.ceil(F.col("members") / F.lit(4096.0)))).orderBy(mixed, "unit")
    chained = headed.withColumn("next", F.lead("unit").over(near)).filter("next IS NOT NULL").select(
        F.least("unit", "next").alias("a"), F.greatest("unit", "next").alias("b")
    )
    candidates = materialize(spokes.unionByName(chained).distinct(), "candidates")
    return with_cosine(candidates, units).filter(F.col("cosine") >= threshold - SLACK)


def group_units(units: DataFrame, components: DataFrame) -> DataFrame:
    """Group number and size of every unit; numbers follow first appearance per app."""
    labelled = units.join(components.withColumnRenamed("node", "unit"), "unit", "left").withColumn(
        "component", F.coalesce("component", "unit")
    )
    groups = labelled.groupBy("app_id", "component").agg(
        F.sum("copies").alias("duplicate_count"), F.count("*").alias("members")
    )
    numbered = number_rows(groups, ["app_id"], "component", "duplicate_group")
    joined = join_frequent(labelled, numbered, ["app_id", "component"], "members", counts=groups)
    return joined.drop("members")


def app_table(reviews: DataFrame) -> DataFrame:
    """Reviews per app; an app of one review or of blank reviews only is trivial."""
    worded = F.count_if(~text.is_blank(F.col("review_text")))
    counted = reviews.groupBy("app_id").agg(F.count("*").alias("app_rows"), worded.alias("worded"))
    return counted.select("app_id", "app_rows", F.expr("app_rows < 2 OR worded = 0").alias("trivial"))


def trivial_groups(reviews: DataFrame, seq: str = "review_seq") -> DataFrame:
    """Rows of trivial apps: every row is its own group, counted from 0."""
    rows = reviews.join(app_table(reviews).filter("trivial").select("app_id"), "app_id", "left_semi")
    return number_rows(rows, ["app_id"], seq, "duplicate_group").withColumns({
        "duplicate_group": F.col("duplicate_group") - 1,
        "duplicate_count": F.lit(1).cast("bigint"),
        "dedupe_method": F.lit("not_required"),
    })


def add_duplicate_groups(
    reviews: DataFrame, threshold: float = DEFAULTS.dedupe_threshold, seq: str = "review_seq"
) -> DataFrame:
    """Add duplicate_group, duplicate_count and dedupe_method to every review.

    Needs `app_id`, `review_text` and a bigint `seq` that is unique over the table
    and gives the order of the reviews.
    """
    # Reviews without an app form one app of their own; joins would lose a null key.
    reviews = reviews.withColumns({"_app": F.col("app_id"), "app_id": F.coalesce("app_id", F.lit("\u0001none"))})
    units = materialize(collapse_copies(reviews, seq), "units", "zstd")
    vectors_table = unit_vectors(units, threshold, only_pairable=True)
    links = materialize(similarity_links(vectors_table, threshold).select("a", "b"), "links")
    components = connected_components(links)
    grouped = group_units(units, components)
    apps = materialize(app_table(reviews), "apps")
    flagged = join_frequent(grouped, apps, ["app_id"], "app_rows", stored=True)
    lookup = flagged.select(
        "app_id",
        unit_digest(F.col("tokens")).alias("unit_digest"),
        "copies",
        F.when(F.col("trivial"), F.col("duplicate_group") - 1).otherwise(F.col("duplicate_group")).alias("duplicate_group"),
        F.when(F.col("trivial"), F.lit(1)).otherwise(F.col("duplicate_count")).cast("bigint").alias("duplicate_count"),
        F.when(F.col("trivial"), "not_required").otherwise("tfidf_fallback").alias("dedupe_method"),
    )
    lookup = materialize(lookup, "groups")
    keyed = with_unit(spread(reviews), seq).withColumn("unit_digest", unit_digest(F.col("tokens"))).drop("tokens")
    joined = join_frequent(keyed, lookup, ["app_id", "unit_digest"], "copies", stored=True)
    return joined.withColumn("app_id", F.col("_app")).drop("unit_digest", "copies", "_app")
