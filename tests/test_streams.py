import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from voicegrid.operators import compete, ledger
from voicegrid.streaming import intake, profiles
from voicegrid.streaming import ledger as stream


def some_events(seed=1):
    rnd, rows, begin = random.Random(seed), [], dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)
    for run in range(12):
        for n in range(60 if run == 0 else rnd.randrange(1, 6)):
            when = begin + dt.timedelta(seconds=rnd.randrange(10_000), microseconds=n)
            kind = "create" if n == 0 and run % 4 else "update"
            rows.append((
                f"run{run}", n, when if rnd.random() < 0.95 else None, kind, f"App {run}" if kind == "create" else None, None,
                rnd.choice([None, "", "running", "completed"]), rnd.choice([None, "", "a", "b"]),
                {k: rnd.choice(["1", "2", None]) for k in rnd.sample("xyz", rnd.randrange(3))} or rnd.choice([{}, None]),
                rnd.choice([None, None, "boom"]),
            ))
    rows = [r if r[0] != "run0" or r[1] else (*r[:3], "create", "App 0", "id0", *r[6:]) for r in rows]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("files_per_batch", [1, 3, 50])
def test_states_kept_by_the_stream_are_the_fold_of_all_events(spark, tmp_path, files_per_batch):
    rows, folder, out = some_events(), str(tmp_path / "events"), str(tmp_path / "states")
    for part in (rows[:50], rows[50:]):
        spark.createDataFrame(part, ledger.EVENT_SCHEMA).repartition(4).write.mode("append").parquet(folder)
        stream.keep_states(stream.events(spark, folder, files_per_batch), out, str(tmp_path / "check")).awaitTermination()
    want = {r["run_id"]: r.asDict() for r in ledger.state(ledger.recorded(spark, folder)).collect()}
    got = {r["run_id"]: r.asDict() for r in stream.states(spark, out).collect()}
    assert set(got) == set(want) and len(got) == 10
    for run, state in want.items():
        assert got[run] == state


def test_only_folders_of_the_batch_are_read(spark, tmp_path):
    path = str(tmp_path / "raw")
    rows = spark.createDataFrame([(a, f"k{n}") for n, a in enumerate(["a", "b", "c", None] * 3)], "app_id string, review_key string")
    rows.write.partitionBy("app_id").parquet(path)
    stored = spark.read.schema(rows.schema).parquet(path)
    for wanted in (["a"], ["a", None], [None], []):
        apps = spark.createDataFrame([(a,) for a in wanted], "app_id string")
        for most in (1000, 0):
            assert intake.of_apps(stored, apps, most).count() == 3 * len(wanted)
    plan = intake.of_apps(stored, spark.createDataFrame([("a",)], "app_id string"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in plan and "Join" not in plan
    assert intake.of_apps(stored, rows.select("app_id").distinct()).filter(F.col("app_id") == "b").count() == 3


@pytest.mark.parametrize("merge", [2, 64])
def test_measures_after_three_increments_equal_the_recomputation(spark, tmp_path, merge):
    rnd = random.Random(3)
    schema = "app_id string, review_text string, category string, sentiment string, rating double, prediction_confidence double, needs_human_review boolean"
    rows = [(
        rnd.choice(["hot", "hot", "b", None]), rnd.choice(["the app crashes often", "great music", "slow battery drain", "", None, "日本"]),
        rnd.choice(["Bug", "Praise", "UI Issue", None]), rnd.choice(["Positive", "Negative", "Neutral"]),
        rnd.choice([None, 1.0, 4.0, 5.0]), rnd.choice([None, 0.25, 0.5, 1.0]), rnd.choice([True, False, None]),
    ) for _ in range(300)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for at in range(0, 300, 100):
        spark.createDataFrame(rows[at:at + 100], schema).repartition(2).write.mode("append").parquet(source)
        stream_in = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        profiles.keep_measures(stream_in, out, str(tmp_path / "check"), merge=merge).awaitTermination()
    everything = spark.createDataFrame(rows, schema)
    want = {tuple(r) for r in compete.measured(everything).select(*sorted(compete.measured(everything).columns)).collect()}
    got = profiles.measures(spark, out)
    assert {tuple(r) for r in got.select(*sorted(got.columns)).collect()} == want
    whole = compete.profile(everything)
    kept = profiles.profiles(spark, out).select("app_id", "average_rating", "praise_rate", "issue_rate").collect()
    assert {tuple(r) for r in kept} == {tuple(r) for r in whole.select("app_id", "average_rating", "praise_rate", "issue_rate").collect()}
