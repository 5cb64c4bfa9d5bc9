"""What the term step keeps on disk: shuffles go once they are read, and only units that can have a partner keep their vectors."""

import os
import time

from pyspark.sql import functions as F

from voicegrid.operators import dedupe
from voicegrid.session import materialize, shared_dir

SCHEMA = "review_seq long, app_id string, review_text string"
ROWS = [(i, "ab"[i % 2], f"one text about item{i // 4} and its colour{i // 4 % 3} with part{i}" + " own" * (i % 2) + f" rare{i} odd{i} lone{i}" * (i % 3)) for i in range(40)]


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def stored(spark, label):
    return {x for x in os.listdir(shared_dir(spark)) if x.startswith(label + "-")}


def test_a_stored_table_leaves_no_shuffle_behind(spark):
    before, setting = shuffle_files(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting)
    table = materialize(spark.range(20_000).groupBy((F.col("id") % 999).alias("k")).agg(F.count("*").alias("n")), "gone")
    deadline = time.time() + 20
    while shuffle_files(spark) - before and time.time() < deadline:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert table.agg(F.sum("n")).first()[0] == 20_000 and spark.conf.get(setting) == was


def test_units_without_partner_keep_no_vector(spark):
    threshold = 0.7
    units = materialize(dedupe.collapse_copies(spark.createDataFrame(ROWS, SCHEMA)), "u")
    every = dedupe.unit_vectors(units, threshold)
    expected = {r["unit"]: r for r in dedupe.pairable(every, threshold).collect()}
    assert 0 < len(expected) < every.count()
    returned, before = stored(spark, "returned"), stored(spark, "terms")
    dedupe.add_duplicate_groups(spark.createDataFrame(ROWS, SCHEMA), threshold).collect()
    (added,) = stored(spark, "terms") - before
    kept = {r["unit"]: r for r in spark.read.parquet(os.path.join(shared_dir(spark), added)).collect()}
    assert kept.keys() == expected.keys()
    assert all(len(kept[u]["terms"]) == len(r["vector"]) and len(kept[u]["rests"]) == len(r["prefix"]) and kept[u]["mass"] == r["mass"] for u, r in expected.items())
    # The table between the two steps is not left behind.
    assert stored(spark, "returned") == returned


def test_turns_do_not_change_vectors(spark, monkeypatch):
    from voicegrid.operators import term_blocks

    units = materialize(dedupe.collapse_copies(spark.createDataFrame(ROWS, SCHEMA)), "u")
    found = []
    for turns in (1, 3):
        monkeypatch.setattr(term_blocks, "TURNS", turns)
        found.append(sorted((r["unit"], round(r["mass"], 9), [(t["k1"], t["k2"], round(t["w"], 9)) for t in r["vector"]], len(r["prefix"])) for r in dedupe.unit_vectors(units).collect()))
    assert found[0] == found[1] and found[0]


def test_many_pairs_take_turns(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "TURN_PAIRS", 3)
    monkeypatch.setattr(dedupe, "LEAST_PAIRS", 1)
    units = dedupe.pairable(dedupe.unit_vectors(materialize(dedupe.collapse_copies(spark.createDataFrame(ROWS, SCHEMA)), "u")), 0.5)
    pairs = materialize(units.select(F.col("unit").alias("a")).join(units.select(F.col("unit").alias("b")), F.expr("a < b")), "pairs")
    before = stored(spark, "cosines")
    found = {(r["a"], r["b"]): r["cosine"] for r in dedupe.with_cosine(pairs, units).collect()}
    assert len(stored(spark, "cosines") - before) == 1
    vectors = {r["unit"]: {(t["k1"], t["k2"]): t["w"] for t in r["vector"]} for r in units.collect()}
    assert len(found) == pairs.count() > 3 * len(vectors)
    assert all(abs(c - sum(w * vectors[b].get(k, 0.0) for k, w in vectors[a].items())) < 1e-9 for (a, b), c in found.items())
