"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voicegrid.operators.skew import join_frequent
from voicegrid.session import materialize


def _lowest(pairs: DataFrame) -> DataFrame:
    """Per node u the lowest of u and its partners, with its number of partners."""
    return pairs.groupBy("u").agg(
        F.least(F.min("v"), F.col("u")).alias("low"), F.count("*").alias("partners")
    )


def _large_star(links: DataFrame) -> DataFrame:
    """Hang every higher partner of a node on the lowest node around it."""
    forward = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    pairs = forward.unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    joined = join_frequent(pairs.filter("v > u"), _lowest(pairs), ["u"], "partners")
    return joined.select(F.col("v").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Hang a node and its lower partners on the lowest of them."""
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    lows = _lowest(pairs)
    joined = join_frequent(pairs, lows, ["u"], "partners").filter("v <> low")
    moved = joined.select(F.col("v").alias("a"), F.col("low").alias("b"))
    own = lows.select(F.col("u").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(own).distinct()


def _settled(links: DataFrame) -> bool:
    """Every node hangs on one root, and no root hangs on anything."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("hangs")).unionAll(
        links.select(F.col("b").alias("node"), F.lit(0).alias("hangs")).distinct()
    )
    return ends.groupBy("node").agg(F.sum("hangs").alias("up"), F.count("*").alias("n")).filter(
        "up > 1 OR (up = 1 AND n > 1)"
    ).isEmpty()


def connected_components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(a, b) links to (node, component), where component is the lowest node reached.

    Alternates the two star steps of Kiveris et al. (SoCC 2014): a few rounds,
    each a pre-aggregated minimum and a join. Stops when the links form stars.
    """
    current = links.select("a", "b").filter("a <> b").distinct()
    for _ in range(rounds):
        current = materialize(_small_star(_large_star(current)), "links")
        if _settled(current):
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = current.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
