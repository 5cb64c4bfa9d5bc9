from pyspark.sql import functions as F

from voicegrid.operators import compete, evidence, ledger, overrides, resolve, summary
from voicegrid.operators.classify import argmax_label, calibration, class_report, confidence, route
from voicegrid.plans import pipeline

PROFILE_SCHEMA = (
    "app_id string, review_text string, rating int, category string, sentiment string, "
    "prediction_confidence double, needs_human_review boolean"
)


def profile_rows(spark):
    rows = [
        ("ours", "great tools inside", 5, "Praise", "Positive", 0.2, True),
        ("ours", "stops after update", 1, "Bug", "Negative", 1.0, False),
        ("rival", "great tools inside", 4, "Praise", "Positive", 1.0, False),
        ("rival", "stops after update", 4, "Praise", "Positive", 1.0, None),
    ]
    return spark.createDataFrame(rows, PROFILE_SCHEMA)


def test_uncertain_labels_weigh_less(spark):
    profiles = {r["app_id"]: r for r in compete.profile(profile_rows(spark)).collect()}
    ours = profiles["ours"]
    assert (ours["sample_size"], ours["queued_reviews"], ours["average_rating"]) == (2, 1, 3.0)
    assert ours["praise_rate"] == 16.7 and ours["issue_rate"] == 83.3 and ours["category_rates"]["Bug"] == 83.3
    assert profiles["rival"]["praise_rate"] == 100.0 and profiles["rival"]["positive_rate"] == 100.0


def test_comparison_and_rank(spark):
    apps = spark.createDataFrame([("ours",), ("rival",), ("gone",)], "app_id string")
    pairs = spark.createDataFrame([("ours", "rival", 0), ("ours", "gone", 1)], "own_id string, competitor_id string, position int")
    profiles = compete.profile(profile_rows(spark), apps=apps)
    gone = profiles.filter("app_id = 'gone'").first()
    assert gone["available"] is False and gone["sample_size"] == 0
    row = compete.comparisons(compete.deltas(compete.paired(profiles, pairs))).collect()
    assert len(row) == 1 and row[0]["our_advantages"] == []
    assert row[0]["our_gaps"][0] == "average rating" and len(row[0]["our_gaps"]) == 4
    rank = compete.market_position(profiles, pairs).first()
    assert (rank["rank"], rank["out_of"]) == (2, 2)
    alone = compete.market_position(profiles, pairs.filter("competitor_id = 'gone'")).first()
    assert alone["rank"] is None and alone["out_of"] == 1
    table = compete.competitor_table(profiles, pairs, apps.withColumn("genre", F.lit("A|B"))).orderBy("position").collect()
    assert [r["product"] for r in table] == ["ours (ours)", "rival"] and table[0]["category"] == "A/B"
    assert table[0]["downloads"] == "—"


def test_theme_support_and_order(spark):
    texts = ["too many ads here"] * 4 + ["payment refund failed"] * 4 + ["it keeps stopping daily"] * 3 + ["LOGIN broken"] * 2
    rows = [("a", t, 1, "Complaint", "Neutral", 1.0, False) for t in texts]
    counts = compete.theme_counts(compete.measured(spark.createDataFrame(rows, PROFILE_SCHEMA)))
    best = [(r["rank"], r["theme"], r["reviews"]) for r in compete.top_themes(counts).orderBy("rank").collect()]
    assert best == [(1, "Advertisements", 4), (2, "Payment and billing", 4), (3, "Crashes and stability", 3)]
    assert compete.top_themes(counts).first()["percentage"] == 30.8


def test_routing(spark):
    rows = [(0.55, 2), (0.55, 0), (0.6, 0)]
    got = route(spark.createDataFrame(rows, "prediction_confidence double, vocabulary_hits long")).collect()
    assert [r["review_route"] for r in got] == ["llm_ambiguity", "translation_or_human", "model_confident"]
    assert [r["needs_human_review"] for r in got] == [True, True, False]
    assert [r["requires_llm_review"] for r in got] == [True, False, False]


def test_confidence_and_label_of_probabilities(spark):
    df = spark.createDataFrame([([0.98, 0.02],), ([0.5, 0.5],), (None,)], "p array<double>")
    got = df.select(confidence(F.col("p")), argmax_label(F.col("p"), ("Bug", "Praise"))).collect()
    assert [tuple(r) for r in got] == [(0.98, "Bug"), (0.5, "Bug"), (1.0, None)]


def test_evaluation_tables(spark):
    rows = [("a", "a", 0.9), ("a", "b", 0.4), ("b", "b", 0.8), ("b", "b", 0.55), ("c", "a", 0.7)]
    predictions = spark.createDataFrame(rows, "actual string, predicted string, confidence double")
    report = {r["label"]: r for r in class_report(predictions).collect()}
    assert report["a"]["precision"] == 0.5 and report["a"]["recall"] == 0.5
    assert report["c"]["precision"] == 0.0 and report["c"]["f1"] == 0.0 and report["c"]["support"] == 1
    assert report["accuracy"]["f1"] == 0.6 and report["macro avg"]["support"] == 5
    curve = {r["threshold"]: (r["coverage"], r["accuracy_when_retained"]) for r in calibration(predictions).collect()}
    assert curve[0.5] == (0.8, 0.75) and curve[0.95] == (0.0, 0.0)


def test_summary_of_missing_columns_and_nulls(spark):
    df = spark.createDataFrame([(None, None, None, True), ("Bug", 4.0, 0.5, None)], "category string, rating double, prediction_confidence double, needs_human_review boolean")
    total = summary.totals(df).first()
    assert tuple(total) == (2, 4.0, 1, 0.5)
    assert tuple(summary.route_counts(df).first()) == (0, 0)
    bins = {r["bin"]: r["reviews"] for r in summary.confidence_histogram(df).collect()}
    assert bins["0.00-0.49"] == 1 and len(bins) == 6 and sum(bins.values()) == 1
    empty = df.filter("false")
    assert tuple(summary.confidence_diagnostics(empty).first()) == (None, None, None)


def override_rows(spark):
    rows = [(i, "Bug", 0.5, True, i != 3, "llm_ambiguity", "xgboost", "text") for i in range(1, 6)]
    schema = ("review_seq long, category string, prediction_confidence double, needs_human_review boolean, "
              "requires_llm_review boolean, review_route string, classification_source string, review_text string")
    return spark.createDataFrame(rows, schema)


def test_overrides_apply_valid_answers_only(spark):
    df = override_rows(spark)
    answers = [(0, '```json\n[{"row": 1, "category": "Praise"}, {"row": 4, "category": "Nonsense"}]\n```'),
               (1, '[{"row": 4, "category": "UI Issue"}, {"row": 1, "category": "UI Issue"}, {"row": 3, "category": "Praise"}]')]
    responses = spark.createDataFrame(answers, "batch long, response string")
    got = {r["review_seq"]: r for r in overrides.resolve_ambiguous(df, responses, size=2).collect()}
    assert got[1]["category"] == "Praise" and got[1]["prediction_confidence"] == 1.0
    assert got[1]["review_route"] == "llm_resolved" and not got[1]["needs_human_review"]
    assert got[4]["category"] == "UI Issue" and got[3]["category"] == "Bug" and got[5]["needs_human_review"]


def test_overrides_change_nothing_when_an_answer_fails(spark):
    df = override_rows(spark)
    before = sorted(map(tuple, df.collect()))
    for answers in ([(0, '[{"row": 1, "category": "Praise"}]')], [(0, '[{"row": 1, "category": "Praise"}]'), (1, "sorry")]):
        responses = spark.createDataFrame(answers, "batch long, response string")
        assert sorted(map(tuple, overrides.resolve_ambiguous(df, responses, size=2).collect())) == before


def test_app_resolution(spark):
    requests = spark.createDataFrame([(" Spotify ",), ("Notes",), ("Maps",), ("Nothing",)], "app_name string")
    candidates = spark.createDataFrame(
        [("Notes", 1, "n.one", "Notes Pro", "5+"), ("Notes", 2, "n.two", "NOTES", "1+"), ("Maps", 1, "m.one", "City Maps", "1,000+"),
         ("Maps", 2, "m.two", None, "9,000+"), ("Nothing", 1, None, "Nothing", "1+")],
        "search_name string, search_rank int, candidate_id string, title string, installs string",
    )
    got = {r["app_name"]: r for r in resolve.resolve_apps(requests, resolve.alias_table(spark), candidates).collect()}
    assert got[" Spotify "]["app_id"] == "com.spotify.music" and got["Notes"]["app_id"] == "n.two"
    assert got["Maps"]["reason"] == "Could not identify 'Maps' exactly. Candidates: City Maps (m.one), m.two (m.two)"
    assert got["Nothing"]["reason"] == "No app found"
    best = {r["competitor"]: (r["resolved_id"], r["confidence"]) for r in resolve.resolve_competitors(candidates).collect()}
    assert best == {"Notes": ("n.two", 0.8), "Maps": ("m.two", 0.5)}


def test_competitor_records(spark):
    apps = spark.createDataFrame([(" YouTube ",), ("unknown",)], "app_name string")
    expanded = resolve.expand_competitors(apps, resolve.competitor_table(spark))
    rows = resolve.competitor_records(expanded, resolve.verified_table(spark)).orderBy("position").collect()
    assert [(r["competitor"], r["verified"]) for r in rows] == [("Netflix", False), ("Disney+", True), ("Instagram Reels", True)]
    assert rows[2]["resolution_note"].startswith("Reels is a feature") and rows[0]["verification_required"]


def test_retrieval(spark):
    docs = spark.createDataFrame(
        [("a.md", "Source: https://example.org/page\n\n Notely added offline playlist controls. \n\nshort"),
         ("b.md", "Weather maps gained a radar layer this spring.\n\n\n\nOffline maps were removed from the free plan.")],
        "source string, text string",
    )
    chunks = evidence.chunk(docs)
    assert {(r["source"], r["chunk"]) for r in chunks.collect()} == {("a.md", 0), ("a.md", 1), ("b.md", 0), ("b.md", 2)}
    assert evidence.chunk_all(docs).count() == 5
    best = evidence.top_k_tfidf(chunks, "Notely offline playlist", limit=2).orderBy(F.desc("score")).collect()
    assert "Notely" in best[0]["text"] and best[0]["score"] > best[1]["score"] > 0
    nearest = evidence.retrieve(chunks, "Notely offline playlist", limit=1).collect()
    assert "Notely" in nearest[0]["text"] and 0 < nearest[0]["score"] <= 1
    assert evidence.top_k_tfidf(chunks, "zzz").count() == 0 and evidence.retrieve(chunks.filter("false"), "x").count() == 0
    assert evidence.upsert(chunks, chunks.withColumn("text", F.lit("new"))).filter("text = 'new'").count() == 4


def test_ledger_round_trip(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    start = ledger.created(spark.createDataFrame([("Example", "com.example")], "app_name string, app_id string"), now)
    run_id = start.select("run_id").first()[0]
    start = spark.createDataFrame(start.limit(1).collect(), ledger.EVENT_SCHEMA).withColumn("run_id", F.lit(run_id))
    updates = spark.createDataFrame(
        [(run_id, 1, None, "update", None, None, None, "analyzing", {"a": "1", "b": "1"}, "boom"),
         (run_id, 2, None, "update", None, None, "needs_review", "", {"b": "2"}, None),
         ("ghost", 1, None, "update", None, None, "completed", None, {}, None)],
        ledger.EVENT_SCHEMA,
    )
    events = start.unionByName(updates)
    states = ledger.state(events)
    row = states.collect()
    assert len(row) == 1 and row[0]["status"] == "needs_review" and row[0]["current_step"] == "analyzing"
    assert row[0]["payload"] == {"a": "1", "b": "2"} and row[0]["error"] is None
    decided = spark.createDataFrame([(run_id, True, "ok"), ("nobody", True, "")], "run_id string, approved boolean, notes string")
    outcomes = ledger.review_outcomes(states, decided)
    assert {r["run_id"]: r["reason"] for r in outcomes.collect()} == {run_id: None, "nobody": "Run not found"}
    after = ledger.state(events.unionByName(ledger.review_events(outcomes, F.lit(3), now))).first()
    assert after["status"] == "completed" and after["current_step"] == "human_reviewed"
    assert after["payload"]["human_review"] == '{"approved":true,"notes":"ok"}'
    assert ledger.latest_runs(states, 0).count() == 1 and ledger.get(states, "nobody").count() == 0


def test_whole_run(spark, tmp_path):
    rows = []
    for app, rating in (("ours", 4), ("rival", 2)):
        for i in range(12):
            category = ("Bug", "Praise", "Feature Request")[i % 3]
            rows.append((len(rows), app, app, f"review {category.lower()} number {i % 4} of great value", rating, i, category,
                         0.5 + i / 30, i % 2, None))
    schema = ("review_seq long, app_id string, app_name string, review_text string, rating int, thumbs_up int, category string, "
              "prediction_confidence double, vocabulary_hits int, review_date timestamp")
    reviews = route(spark.createDataFrame(rows, schema))
    pairs = spark.createDataFrame([("ours", "rival", 0), ("ours", "gone", 1)], "own_id string, competitor_id string, position int")
    apps = spark.createDataFrame([("ours", "Ours"), ("rival", "Rival")], "app_id string, app_name string")
    result = pipeline.run("r1", reviews, pairs, apps, output=str(tmp_path / "out"))
    assert result.analyzed.count() == 24
    assert result.market_position.first()["rank"] == 1
    assert [r["competitor_id"] for r in result.skipped.collect()] == ["gone"]
    assert result.status.first()["status"] == "needs_review"
    assert result.summary.filter("app_id = 'ours'").first()["total_reviews"] == 12
    assert result.features.count() >= 1 and result.comparison_table.count() == 2
    assert spark.read.parquet(str(tmp_path / "out/human_review")).count() == result.review_queue.count()
