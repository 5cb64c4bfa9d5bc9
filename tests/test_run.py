from dataclasses import replace

import pytest

from voicegrid.config import DEFAULTS
from voicegrid.operators import ledger
from voicegrid.operators.classify import route
from voicegrid.plans import pipeline

SCHEMA = ("review_seq long, app_id string, app_name string, review_text string, rating int, thumbs_up int, category string, "
          "prediction_confidence double, vocabulary_hits int, review_date timestamp")
PAIRS = "own_id string, competitor_id string, position int"


@pytest.fixture(scope="module")
def reviews(spark):
    rows = []
    for app, rating in (("ours", 4), ("alone", 5), ("rival", 2)):
        for i in range(12):
            category = ("Bug", "Praise", "Feature Request")[i % 3]
            rows.append((len(rows), app, app, f"review {category.lower()} number {i % 4} of great value", rating, i, category,
                         0.5 + i / 30, i % 2, None))
    return route(spark.createDataFrame(rows, SCHEMA))


@pytest.fixture(scope="module")
def apps(spark):
    return spark.createDataFrame([("ours", "Ours"), ("rival", "Rival"), ("alone", "Alone")], "app_id string, app_name string")


def test_apps_without_competitors_stay(spark, reviews, apps):
    pairs = spark.createDataFrame([("ours", "rival", 0)], PAIRS)
    own = spark.createDataFrame([("alone",), ("ours",)], "app_id string")
    result = pipeline.run("r1", reviews, pairs, apps, own_apps=own)
    assert {r["app_id"]: r["total_reviews"] for r in result.summary.collect()} == {"ours": 12, "alone": 12}
    position = {r["own_id"]: (r["rank"], r["out_of"]) for r in result.market_position.collect()}
    assert position == {"ours": (1, 2), "alone": (None, 1)}
    shown = {(r["own_id"], r["product"]) for r in result.comparison_table.collect()}
    assert shown == {("ours", "Ours (ours)"), ("ours", "Rival"), ("alone", "Alone (ours)")}


def test_no_pairs_at_all(spark, reviews, apps):
    own = spark.createDataFrame([("alone",)], "app_id string")
    result = pipeline.run("r2", reviews, spark.createDataFrame([], PAIRS), apps, own_apps=own)
    assert result.analyzed.count() == 12 and result.skipped.count() == 0 and result.comparisons.count() == 0
    assert [r["product"] for r in result.comparison_table.collect()] == ["Alone (ours)"]


def test_summaries_are_per_app(spark, reviews, apps):
    pairs = spark.createDataFrame([("ours", "rival", 0), ("alone", "rival", 0)], PAIRS)
    result = pipeline.run("r3", reviews, pairs, apps)
    counts = {(r["app_id"], r["dimension"], r["value"]): r["reviews"] for r in result.distributions.collect()}
    assert all(counts[app, "category", c] == 4 for app in ("ours", "alone") for c in ("Bug", "Praise", "Feature Request"))
    assert not any(app == "rival" for app, _, _ in counts)
    bins = {}
    for r in result.histogram.collect():
        bins.setdefault(r["app_id"], []).append(r["reviews"])
    assert {app: (len(b), sum(b)) for app, b in bins.items()} == {"ours": (6, 12), "alone": (6, 12)}
    spans = {r["app_id"]: (r["minimum"], r["maximum"], r["mean"]) for r in result.diagnostics.collect()}
    assert spans == {app: (0.5, 0.867, 0.683) for app in ("ours", "alone")}
    waiting = {r["app_id"]: r["llm_ambiguity_reviews"] + r["translation_or_human_reviews"] for r in result.routes.collect()}
    queued = {r["app_id"]: r["queued_reviews"] for r in result.quality.collect()}
    assert waiting == queued == {"ours": 3, "alone": 3}


def test_evidence_answers_each_app(spark, reviews, apps):
    chunks = spark.createDataFrame(
        [("1", "a", "Ours release notes of this year"), ("2", "b", "Alone has new product features"), ("3", "c", "the the the")],
        "id string, source string, text string",
    )
    own = spark.createDataFrame([("ours",), ("alone",)], "app_id string")
    settings = replace(DEFAULTS, evidence_stopwords=("the", "of"))
    result = pipeline.run("r4", reviews, spark.createDataFrame([], PAIRS), apps, settings=settings, chunks=chunks, own_apps=own)
    first = {r["app_id"]: (r["id"], r["source"]) for r in result.evidence.collect() if r["rank"] == 1}
    assert first == {"ours": ("1", "a"), "alone": ("2", "b")}
    assert "3" not in {r["id"] for r in result.evidence.collect()}


def test_ledger_follows_the_run(spark, reviews, apps, tmp_path):
    folder = str(tmp_path / "events")
    pairs = spark.createDataFrame([("ours", "rival", 0)], PAIRS)
    pipeline.run("good", reviews, pairs, apps, output=str(tmp_path / "out"), events=folder)
    with pytest.raises(RuntimeError, match="no reviews"):
        pipeline.run("bad", reviews.limit(0), pairs, apps, events=folder)
    states = {r["run_id"]: r for r in ledger.state(ledger.recorded(spark, folder)).collect()}
    assert (states["good"]["status"], states["good"]["current_step"], states["good"]["error"]) == ("needs_review", "finished", None)
    assert states["good"]["payload"]["data_path"].endswith("/runs")
    assert (states["bad"]["status"], states["bad"]["current_step"]) == ("failed", "failed")
    assert states["bad"]["error"].startswith("RuntimeError: no reviews")


def test_from_names_to_the_report(spark, reviews, apps):
    requests = spark.createDataFrame([("Ours",), ("Alone",), ("Nobody",)], "app_name string")
    candidates = spark.createDataFrame(
        [("Alone", 0, "alone", "Alone", "5"), ("Rival", 0, "rival", "Rival", "10"), ("Silent", 0, "silent", "Silent app", "7")],
        "search_name string, search_rank int, candidate_id string, title string, installs string",
    )
    aliases = spark.createDataFrame([("ours", "ours")], "alias string, alias_id string")
    rivals = spark.createDataFrame([("ours", ["Rival", "Silent", "Lost"])], "app_key string, competitors array<string>")
    verified = spark.createDataFrame([("rival", "rival", "a note")], "name_key string, verified_id string, note string")
    result = pipeline.run_by_name("r5", requests, candidates, reviews, apps, aliases, rivals, verified)
    assert [(r["app_name"], r["reason"]) for r in result.unresolved.collect()] == [("Nobody", "No app found")]
    assert {(r["own_id"], r["competitor"], r["reason"]) for r in result.skipped.collect()} == {
        ("ours", "Silent", "No reviews returned"), ("ours", "Lost", "No Play Store app found"),
    }
    notes = {r["competitor"]: r["resolution_note"] for r in result.competitors.collect()}
    assert notes["Rival"] == "a note" and notes["Silent"].startswith("Resolved automatically to Silent app (silent)") and notes["Lost"] is None
    assert {r["own_id"] for r in result.comparison_table.collect()} == {"ours", "alone"}
    assert {r["app_id"] for r in result.summary.collect()} == {"ours", "alone"}
