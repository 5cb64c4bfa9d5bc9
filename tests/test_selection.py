import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from voicegrid.operators import intake, selection

SCHEMA = "app_id string, review_seq long, review_date timestamp, review_text string"


def some_reviews(seed=1, count=3000):
    rnd = random.Random(seed)
    begin = dt.datetime(2024, 1, 1)
    rows = []
    for n in range(count):
        app = rnd.choice(["hot"] * 5 + ["a", "b", None])
        when = rnd.choice([
            begin + dt.timedelta(seconds=rnd.randrange(40 * 86400)), begin + dt.timedelta(days=39, seconds=rnd.randrange(90)),
            begin + dt.timedelta(days=rnd.randrange(3)), None,
        ])
        rows.append((app, n, when, f"text {n}"))
    return rows + [("undated", 10_000 + n, None, "x") for n in range(50)] + [("solo", 20_000, begin, "y")]


@pytest.mark.parametrize("count", [1, 7, 40, 800, 100_000])
def test_newest_rows_of_every_app(spark, count):
    rows = some_reviews()
    want = set()
    for app in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == app), key=lambda r: (r[2] is None, -(r[2] or dt.datetime(1970, 1, 1)).timestamp(), r[1]))
        want |= {r[1] for r in own[:count]}
    found = intake.latest_reviews(spark.createDataFrame(rows, SCHEMA).repartition(5), count)
    got = [r["review_seq"] for r in found.collect()]
    assert found.columns == ["app_id", "review_seq", "review_date", "review_text"] and len(got) == len(set(got)) and set(got) == want


def test_no_text_is_shuffled(spark, tmp_path):
    spark.createDataFrame(some_reviews(), SCHEMA).write.parquet(str(tmp_path / "r"))
    found = intake.latest_reviews(spark.read.parquet(str(tmp_path / "r")), 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan
    assert found.select(F.count("*")).first()[0] == 51


def test_dates_and_nothing(spark):
    dated = spark.createDataFrame([("a", 1, dt.date(2024, 1, 2)), ("a", 2, dt.date(2024, 1, 3)), ("a", 3, None)], "k string, s int, d date")
    assert [r["s"] for r in selection.newest(dated, "k", "d", "s", 1).collect()] == [2]
    assert selection.newest(dated.limit(0), "k", "d", "s", 5).count() == 0
