from pyspark.sql import functions as F

from voicegrid.operators import skew
from voicegrid.operators.classify import stratified_split, test_quotas as quotas
from voicegrid.operators.components import connected_components


def hot_rows(spark, n=3000):
    """A third of the rows share one key."""
    return spark.range(n).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k")
    )


def test_top_n_per_key_is_exact_on_a_hot_key(spark):
    rows = hot_rows(spark).withColumn("v", F.xxhash64("id"))
    got = skew.top_n_per_key(rows, ["k"], [F.desc("v"), F.asc("id")], 7, "id", slices=16)
    assert got.columns == ["id", "k", "v"]
    frame = rows.toPandas().sort_values(["v", "id"], ascending=[False, True])
    expected = frame.groupby("k").head(7)
    assert set(got.toPandas()["id"]) == set(expected["id"])


def test_join_frequent_takes_all_three_ways(spark):
    rows = hot_rows(spark)
    lookup = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    expected = {tuple(r) for r in rows.join(lookup, "k").select("id", "k", "n", "top").collect()}
    for hot_keys in (1000, 20, 2):
        joined = skew.join_frequent(rows, lookup, ["k"], "n", hot_keys=hot_keys)
        got = [tuple(r) for r in joined.select("id", "k", "n", "top").collect()]
        assert len(got) == 3000 and set(got) == expected


def test_number_rows_is_dense_and_ordered(spark):
    rows = hot_rows(spark).withColumn("seq", F.col("id") * 1_000_003 - 500)
    frame = skew.number_rows(rows, ["k"], "seq", "n").toPandas().sort_values("seq")
    for _, part in frame.groupby("k"):
        assert list(part["n"]) == list(range(1, len(part) + 1))


def test_one_outlier_does_not_fill_a_range(spark):
    rows = spark.range(40_000).withColumn("k", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)))
    rows = rows.withColumn("seq", F.when(F.col("id") == 7, 1 << 60).otherwise(F.col("id"))).withColumn("one", F.lit(1).cast("bigint"))
    depths = [r["count"] for r in skew.depth_ranges(rows, ["k"], ["seq"]).groupBy("_range").count().collect()]
    assert len(depths) > 2 and max(depths) <= 2 * sum(depths) / len(depths)
    frame = skew.number_rows(rows, ["k"], "seq", "n").toPandas().sort_values("seq")
    for _, part in frame.groupby("k"):
        assert list(part["n"]) == list(range(1, len(part) + 1))


def test_running_sums_by_key(spark):
    rows = hot_rows(spark).withColumn("v", F.col("id") % 7)
    frame = skew.running_sums(rows, ["k"], [F.desc("id")], "v", "before").toPandas().sort_values("id", ascending=False)
    for _, part in frame.groupby("k"):
        assert list(part["before"]) == list(part["v"].cumsum() - part["v"])


def test_number_rows_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, seq long")
    assert skew.number_rows(empty, ["k"], "seq", "n").count() == 0


def test_components_of_chains_stars_and_pairs(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, j) for j in range(101, 160)] + [(200, 201), (201, 200), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 61)} == {1}
    assert {got[j] for j in range(100, 160)} == {100}
    assert got[200] == got[201] == 200 and len(got) == 60 + 60 + 2


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_split_takes_exact_shares(spark):
    rows = hot_rows(spark, 1003).select(F.col("id").alias("review_seq"), F.substring("k", 1, 2).alias("category"))
    split = stratified_split(rows)
    frame = split.toPandas()
    wanted = {r["category"]: r["quota"] for r in quotas(rows, "category", 0.2).collect()}
    assert len(frame) == 1003 and frame["is_test"].sum() == 201
    assert frame[frame["is_test"]].groupby("category").size().to_dict() == {k: v for k, v in wanted.items() if v}
    assert set(frame["review_seq"]) == set(range(1003))
    again = stratified_split(rows.repartition(5)).toPandas()
    assert set(again[again["is_test"]]["review_seq"]) == set(frame[frame["is_test"]]["review_seq"])


def test_many_to_many_join_in_cells(spark):
    left, right = hot_rows(spark).select("k", F.col("id").alias("l")), hot_rows(spark).filter("id % 7 = 0").select("k", F.col("id").alias("r"))
    want = {tuple(r) for r in left.join(right, "k").select("l", "r").collect()}
    for depth in (10_000, 100, 7):
        one, two, cell = skew.dealt_cells(left, right, ["k"], depth)
        got = [tuple(r) for r in one.join(two, cell).select("l", "r").collect()]
        assert len(got) == len(want) and set(got) == want


def test_a_block_of_many_members_spreads_over_all_tasks(spark):
    rows = spark.range(50_000).select(F.lit(1).alias("k"), F.col("id").alias("u"))
    one, two, cell = skew.dealt_cells(rows, rows.withColumnRenamed("u", "v"), ["k"])
    for side in (one, two):
        depths = [r["count"] for r in side.groupBy(*cell).count().collect()]
        assert len(depths) == 98 * 98 and max(depths) < 1.5 * skew.CELL_ROWS
