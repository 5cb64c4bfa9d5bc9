"""The whole analysis as one plan over all apps."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voicegrid.config import DEFAULTS, Settings
from voicegrid.operators import classify, compete, intake, ledger, overrides, priority, resolve, search_index, summary
from voicegrid.operators.dedupe import add_duplicate_groups
from voicegrid.operators.sentiment import add_sentiment
from voicegrid.session import materialize
from voicegrid.sources import writers


def enrich(scored: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Sentiment, duplicate groups and priority of classified reviews."""
    spoken = add_sentiment(scored, settings.positive_words, settings.negative_words)
    grouped = add_duplicate_groups(spoken, settings.dedupe_threshold)
    return priority.add_priority(grouped, settings.category_weights)


def analyze(reviews: DataFrame, model=None, settings: Settings = DEFAULTS, responses: DataFrame | None = None) -> DataFrame:
    """Classify (unless the reviews carry categories), enrich, apply label decisions, score again."""
    scored = reviews if model is None else classify.score(reviews, model, settings.classification_threshold)
    if model is not None:
        # Model scoring feeds several later steps; run it once.
        scored = materialize(scored, "scored")
    analyzed = enrich(scored, settings)
    if responses is None:
        return analyzed
    resolved = overrides.resolve_ambiguous(analyzed, responses, settings.override_batch_rows)
    return priority.add_priority(resolved, settings.category_weights)


@dataclass
class Analysis:
    """Tables of one run; all but `analyzed` are lazy. Tables about own apps have one or more rows per `app_id` or `own_id`."""

    analyzed: DataFrame
    review_queue: DataFrame
    skipped: DataFrame
    profiles: DataFrame
    comparisons: DataFrame
    market_position: DataFrame
    comparison_table: DataFrame
    features: DataFrame
    summary: DataFrame
    distributions: DataFrame
    histogram: DataFrame
    diagnostics: DataFrame
    routes: DataFrame
    quality: DataFrame
    status: DataFrame
    evidence: DataFrame | None = None
    unresolved: DataFrame | None = None
    competitors: DataFrame | None = None


def app_evidence(chunks: DataFrame, own: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(app_id, rank, id, text, source, score): the best chunks for every own app (app_id, app_name)."""
    stored = chunks.withColumn("_all", F.lit("all"))
    index = search_index.build_index(stored, settings.evidence_stopwords, app="_all")
    asked = own.select(
        F.lit("all").alias("app_id"), F.col("app_id").alias("question_id"),
        F.format_string(settings.evidence_question, F.coalesce("app_name", "app_id")).alias("text"),
    )
    found = search_index.search(index, asked, settings.evidence_limit)
    best = found.select(F.col("question_id").alias("app_id"), "rank", "id", "score")
    # A few rows per own app, so these are what is sent around.
    return best.join(chunks.select("id", "text", "source"), "id").select("app_id", "rank", "id", "text", "source", "score")


def run(
    run_id: str,
    reviews: DataFrame,
    pairs: DataFrame,
    apps: DataFrame,
    model=None,
    settings: Settings = DEFAULTS,
    responses: DataFrame | None = None,
    chunks: DataFrame | None = None,
    output: str | None = None,
    own_apps: DataFrame | None = None,
    events: str | None = None,
) -> Analysis:
    """Analyse own apps and their competitors together.

    `pairs` holds (own_id, competitor_id, position); `own_apps` (app_id) names own apps, also those without competitors. The newest
    reviews of all apps are taken with the same count; there is no loop over competitors. With `chunks` (id, source, text), evidence
    is retrieved for every own app. Steps, and a failure, go to the ledger folder `events`.
    """
    log = ledger.Recorder(reviews.sparkSession, events, run_id)
    log.create()
    try:
        log.step("collecting")
        pairs = pairs.filter(F.col("position") < settings.max_competitors)
        ours = compete.own_ids(pairs, own_apps).withColumnRenamed("own_id", "app_id")
        everyone = ours.union(pairs.select("competitor_id"))
        sample = intake.require_rows(resolve.matched_samples(reviews, everyone, settings.review_count))
        log.step("analyzing")
        # Every report reads the analyzed rows, so they are stored once.
        analyzed = materialize(
            analyze(sample, model, settings, responses).withColumn("run_id", F.lit(run_id)), "analyzed"
        )
        own = analyzed.join(ours, "app_id", "left_semi")
        log.step("market_research")
        profiles = compete.profile(analyzed, settings.topic_patterns, everyone, settings.theme_limit)
        records = pairs.select("own_id", "competitor_id", "position")
        named = ours.join(apps.select("app_id", *[c for c in ("app_name",) if c in apps.columns]), "app_id", "left")
        if "app_name" not in named.columns:
            named = named.withColumn("app_name", F.lit(None).cast("string"))
        key = ["app_id"]
        result = Analysis(
            analyzed=analyzed,
            review_queue=writers.review_queue(own),
            skipped=resolve.skipped_competitors(records, analyzed),
            profiles=profiles,
            comparisons=compete.comparisons(compete.deltas(compete.paired(profiles, pairs))),
            market_position=compete.market_position(profiles, pairs, ours),
            comparison_table=compete.competitor_table(profiles, pairs, apps, ours),
            features=priority.with_rationale(priority.build_feature_ranking(own, settings.feature_limit, keys=key)),
            summary=summary.totals(own, key),
            distributions=summary.distributions(own, keys=key),
            histogram=summary.confidence_histogram(own, key),
            diagnostics=summary.confidence_diagnostics(own, keys=key),
            routes=summary.route_counts(own, key),
            quality=summary.queue_quality(own, key),
            status=ledger.final_status(own),
            evidence=None if chunks is None else app_evidence(chunks, named.dropDuplicates(["app_id"]), settings),
        )
        log.step("reporting")
        paths = {}
        if output:
            writers.write_run(result.analyzed, f"{output}/runs")
            writers.write_review_queue(own, f"{output}/human_review")
            paths = {"data_path": f"{output}/runs", "review_queue_path": f"{output}/human_review"}
        if events is not None:
            waiting = ledger.review_gate(own).first()["requires_human_review"]
            log.step("finished", "needs_review" if waiting else "completed", paths)
        return result
    except Exception as error:
        log.fail(error)
        raise


def run_by_name(
    run_id: str,
    requests: DataFrame,
    candidates: DataFrame,
    reviews: DataFrame,
    apps: DataFrame,
    aliases: DataFrame | None = None,
    rivals: DataFrame | None = None,
    verified: DataFrame | None = None,
    settings: Settings = DEFAULTS,
    **options,
) -> Analysis:
    """From app names to the analysis: `requests` (app_name), `candidates` as the store's search gives them.

    Names are resolved by alias, then by exact title; competitors come from the table of `rivals`, their ids from `verified` or
    from the search. The result also has `unresolved` (names with a reason), `competitors` (with how they were found), and in
    `skipped` both competitors without an id and those without reviews.
    """
    spark = requests.sparkSession
    names = requests.select("app_name").distinct()
    found = materialize(
        resolve.resolve_apps(names, resolve.alias_table(spark) if aliases is None else aliases, candidates), "resolved"
    )
    known = found.filter("app_id IS NOT NULL").select("app_name", "app_id")
    expanded = resolve.expand_competitors(
        known, resolve.competitor_table(spark) if rivals is None else rivals, settings.max_competitors
    )
    records = resolve.competitor_records(expanded, resolve.verified_table(spark) if verified is None else verified)
    records = materialize(resolve.with_resolution(records, resolve.resolve_competitors(candidates)), "competitors")
    own = known.select("app_id").distinct()
    pairs = records.filter("competitor_id IS NOT NULL").select(F.col("app_id").alias("own_id"), "competitor_id", "position").distinct()
    result = run(run_id, reviews, pairs, apps, settings=settings, own_apps=own, **options)
    missing = records.filter("competitor_id IS NULL").select(
        F.col("app_id").alias("own_id"), "competitor", F.lit("No Play Store app found").alias("reason")
    )
    titles = records.select(F.col("app_id").alias("own_id"), "competitor_id", "competitor").distinct()
    silent = result.skipped.join(titles, ["own_id", "competitor_id"], "left").select("own_id", "competitor", "reason")
    return replace(
        result, skipped=silent.unionByName(missing), unresolved=found.filter("app_id IS NULL").select("app_name", "reason"),
        competitors=records,
    )
