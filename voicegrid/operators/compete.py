"""Review profiles of apps, their themes, and comparison with competitors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicegrid.config import DEFAULTS, ISSUE_CATEGORIES, RATE_CATEGORIES, TOPIC_PATTERNS
from voicegrid.functions import numeric, text
from voicegrid.session import spread

# Metric column, reported label, is higher better, smallest difference that counts.
METRICS = (
    ("average_rating", "average rating", True, 0.05),
    ("positive_rate", "positive-feedback rate", True, 1.0),
    ("praise_rate", "confidence-weighted praise rate", True, 1.0),
    ("issue_rate", "confidence-weighted issue rate", False, 1.0),
)
THEME_TYPE = "array<struct<theme: string, reviews: bigint, percentage: double>>"


def _sum_if(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value).otherwise(0.0))


def _prepared(df: DataFrame) -> DataFrame:
    """Review columns with the defaults a profile uses for absent ones."""

    def given(name, default, kind):
        return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default).cast(kind)

    rating = numeric.to_number(F.col("rating")) if "rating" in df.columns else F.lit(None).cast("double")
    confidence = F.lit(0.0)
    if "prediction_confidence" in df.columns:
        confidence = F.coalesce(numeric.to_number(F.col("prediction_confidence")), F.lit(0.0))
    return df.select(
        "app_id",
        F.coalesce("review_text", F.lit("")).alias("review_text"),
        given("category", "", "string").alias("category"),
        given("sentiment", "Neutral", "string").alias("sentiment"),
        given("needs_human_review", False, "boolean").alias("queued"),
        rating.alias("rating"),
        confidence.alias("confidence"),
    ).withColumns({
        "valid": text.is_interpretable(F.col("review_text")),
        "in_praise": (F.col("sentiment") == "Positive") | (F.col("category") == "Praise"),
        "in_issue": F.col("category").isin(*ISSUE_CATEGORIES),
    })


def _measures(patterns: dict[str, str]) -> dict[str, Column]:
    """Additive measures; the same pass serves rates and themes."""
    valid, confidence = F.col("valid"), F.col("confidence")
    measures = {
        "sample_size": F.count("*"),
        "interpretable": F.count_if(valid),
        "queued": F.count_if("queued"),
        "rating_sum": F.sum("rating"),
        "rated": F.count("rating"),
        "positive": F.count_if(valid & (F.col("sentiment") == "Positive")),
        "negative": F.count_if(valid & (F.col("sentiment") == "Negative")),
        "weight": _sum_if(valid, confidence),
        "praise_weight": _sum_if(valid & (F.col("category") == "Praise"), confidence),
        "issue_weight": _sum_if(valid & F.col("in_issue"), confidence),
    }
    for i, label in enumerate(RATE_CATEGORIES):
        measures[f"category_weight_{i}"] = _sum_if(valid & (F.col("category") == label), confidence)
    for i in range(len(patterns)):
        measures[f"topic_{i}"] = F.count_if(F.col(f"hit_{i}"))
    return measures


def measured(df: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """Measures per (app, praise subset, issue subset): four small rows per app at most.

    Grouping by the two subset flags means every pattern runs once per review
    although both subsets count it.
    """
    patterns = TOPIC_PATTERNS if patterns is None else patterns
    prepared = _prepared(spread(df))
    folded = text.casefold(F.col("review_text"))
    hits = {f"hit_{i}": folded.rlike("(?U)" + p) for i, p in enumerate(patterns.values())}
    grouped = prepared.withColumns(hits).groupBy("app_id", "in_praise", "in_issue")
    return grouped.agg(*[c.alias(n) for n, c in _measures(patterns).items()])


def theme_counts(measures: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """(app, subset, theme, position, reviews, subset_size), zero counts included."""
    names = list(TOPIC_PATTERNS if patterns is None else patterns)
    both = F.array(
        F.struct(F.lit("praise").alias("subset"), F.col("in_praise").alias("member")),
        F.struct(F.lit("issue").alias("subset"), F.col("in_issue").alias("member")),
    )
    counted = (
        measures.withColumn("_s", F.explode(both))
        .filter("_s.member")
        .groupBy("app_id", F.col("_s.subset").alias("subset"))
        .agg(F.sum("sample_size").alias("subset_size"), *[F.sum(f"topic_{i}").alias(f"topic_{i}") for i in range(len(names))])
    )
    entries = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(n).alias("theme"), F.col(f"topic_{i}").alias("reviews"))
        for i, n in enumerate(names)
    ])
    return counted.select("app_id", "subset", "subset_size", entries.alias("entries"))


def _supported(limit: int | None) -> Column:
    """Entries with enough reviews, most reviews first, ties in pattern order."""
    needed = F.greatest(F.lit(3), F.floor(F.col("subset_size") * 0.01 + 0.999))
    kept = F.filter("entries", lambda e: e["reviews"] >= needed)
    ordered = F.sort_array(
        F.transform(kept, lambda e: F.struct((-e["reviews"]).alias("order"), e["position"].alias("position"),
                                             e["theme"].alias("theme"), e["reviews"].alias("reviews")))
    )
    return ordered if limit is None else F.slice(ordered, 1, limit)


def top_themes(counts: DataFrame, limit: int | None = DEFAULTS.theme_limit) -> DataFrame:
    """Best supported themes per app and subset; ranked inside the row, no shuffle."""
    listed = counts.select("app_id", "subset", "subset_size", F.posexplode(_supported(limit)).alias("rank", "e"))
    return listed.select(
        "app_id", "subset", "subset_size", (F.col("rank") + 1).alias("rank"),
        F.col("e.theme").alias("theme"), F.col("e.reviews").alias("reviews"),
        numeric.rate(F.col("e.reviews") / F.col("subset_size")).alias("percentage"),
    )


def theme_lists(counts: DataFrame, limit: int = DEFAULTS.theme_limit) -> DataFrame:
    """Themes of an app as two arrays."""
    entry = F.transform(
        _supported(limit),
        lambda e: F.struct(
            e["theme"].alias("theme"), e["reviews"].alias("reviews"),
            numeric.rate(e["reviews"] / F.col("subset_size")).alias("percentage"),
        ),
    )
    listed = counts.select("app_id", "subset", entry.alias("themes"))
    none = F.array().cast(THEME_TYPE)
    return listed.groupBy("app_id").agg(
        F.coalesce(F.max_by("themes", F.when(F.col("subset") == "praise", 1)), none).alias("praise_themes"),
        F.coalesce(F.max_by("themes", F.when(F.col("subset") == "issue", 1)), none).alias("issue_themes"),
    )


def rates(measures: DataFrame) -> DataFrame:
    """Counts, mean rating and percentages per app from the additive measures."""
    names = [c for c in measures.columns if c not in ("app_id", "in_praise", "in_issue") and not c.startswith("topic_")]
    total = measures.groupBy("app_id").agg(*[F.sum(n).alias(n) for n in names])

    def share(part, whole):
        return numeric.rate(F.coalesce(F.col(part) / F.nullif(F.col(whole), F.lit(0)), F.lit(0.0)))

    mean_rating = F.coalesce(F.col("rating_sum") / F.nullif(F.col("rated"), F.lit(0)), F.lit(0.0))
    return total.select(
        "app_id",
        F.lit(True).alias("available"),
        "sample_size",
        F.col("interpretable").alias("interpretable_reviews"),
        (F.col("sample_size") - F.col("interpretable")).alias("uninterpretable_reviews"),
        F.col("queued").alias("queued_reviews"),
        numeric.round_even(mean_rating, 2).alias("average_rating"),
        share("positive", "interpretable").alias("positive_rate"),
        share("negative", "interpretable").alias("negative_rate"),
        share("praise_weight", "weight").alias("praise_rate"),
        share("issue_weight", "weight").alias("issue_rate"),
        share("weight", "interpretable").alias("confidence_coverage"),
        F.create_map(*[
            part for i, label in enumerate(RATE_CATEGORIES) for part in (F.lit(label), share(f"category_weight_{i}", "weight"))
        ]).alias("category_rates"),
    )


def profile(df: DataFrame, patterns: dict[str, str] | None = None, apps: DataFrame | None = None,
            limit: int = DEFAULTS.theme_limit) -> DataFrame:
    """One row per app; with `apps` given, apps without reviews appear as unavailable."""
    measures = measured(df, patterns)
    profiles = rates(measures).join(theme_lists(theme_counts(measures, patterns), limit), "app_id", "left")
    none = F.array().cast(THEME_TYPE)
    profiles = profiles.withColumns({c: F.coalesce(c, none) for c in ("praise_themes", "issue_themes")})
    if apps is None:
        return profiles
    return with_unavailable(profiles, apps)


def with_unavailable(profiles: DataFrame, apps: DataFrame) -> DataFrame:
    listed = apps.select("app_id").distinct().join(profiles, "app_id", "left")
    return listed.withColumns({
        "available": F.coalesce("available", F.lit(False)),
        "sample_size": F.coalesce("sample_size", F.lit(0)),
    })


def paired(profiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """(own_id, competitor_id) pairs with both profiles; unavailable competitors drop out."""
    columns = [m[0] for m in METRICS]
    available = profiles.filter("available")
    own = available.select(F.col("app_id").alias("own_id"), *[F.col(c).alias("own_" + c) for c in columns])
    rival = available.select(F.col("app_id").alias("competitor_id"), *[F.col(c).alias("rival_" + c) for c in columns])
    return pairs.select("own_id", "competitor_id").join(own, "own_id").join(rival, "competitor_id")


def deltas(joined: DataFrame) -> DataFrame:
    """One row per pair and metric: own value minus the competitor's."""
    entries = F.array(*[
        F.struct(
            F.lit(i).alias("metric_no"), F.lit(label).alias("metric"),
            (F.col("own_" + column) - F.col("rival_" + column)).alias("delta"),
            F.lit(better).alias("higher_is_better"), F.lit(least).alias("least"),
        )
        for i, (column, label, better, least) in enumerate(METRICS)
    ])
    return joined.select("own_id", "competitor_id", F.inline(entries))


def comparisons(delta_rows: DataFrame) -> DataFrame:
    """Material differences per pair as two ordered label lists."""
    ahead = F.when(F.col("higher_is_better"), F.col("delta") > 0).otherwise(F.col("delta") < 0)
    material = F.abs("delta") >= F.col("least")
    entry = F.struct("metric_no", "metric")

    def labels(condition):
        collected = F.sort_array(F.collect_list(F.when(condition, entry)))
        return F.transform(collected, lambda e: e["metric"])

    return delta_rows.groupBy("own_id", "competitor_id").agg(
        labels(material & ahead).alias("our_advantages"), labels(material & ~ahead).alias("our_gaps")
    )


def market_position(profiles: DataFrame, pairs: DataFrame, own_apps: DataFrame | None = None) -> DataFrame:
    """Rank of every own app among itself and its competitors: one plus those strictly ahead.

    `own_apps` (app_id) adds apps without competitors: no rank, out of one.
    """
    joined = paired(profiles, pairs)
    own = F.struct("own_average_rating", "own_positive_rate")
    rival = F.struct(
        F.col("rival_average_rating").alias("own_average_rating"), F.col("rival_positive_rate").alias("own_positive_rate")
    )
    ranked = joined.groupBy("own_id").agg((F.count_if(rival > own) + 1).alias("rank"), (F.count("*") + 1).alias("out_of"))
    apps = own_ids(pairs, own_apps)
    return apps.join(ranked, "own_id", "left").withColumn("out_of", F.coalesce("out_of", F.lit(1)))


def own_ids(pairs: DataFrame, own_apps: DataFrame | None = None) -> DataFrame:
    """Own apps of the pairs, and of `own_apps` (app_id) if given, once each."""
    ids = pairs.select("own_id")
    return (ids if own_apps is None else ids.union(own_apps.select("app_id"))).filter("own_id IS NOT NULL").distinct()


def competitor_table(profiles: DataFrame, pairs: DataFrame, apps: DataFrame, own_apps: DataFrame | None = None) -> DataFrame:
    """The thirteen comparison columns, the own app first, then its competitors."""
    rows = pairs.select("own_id", F.col("competitor_id").alias("app_id"), (F.col("position") + 1).alias("position"))
    own = own_ids(pairs, own_apps).select("own_id", F.col("own_id").alias("app_id"), F.lit(0).alias("position"))
    listed = own.unionByName(rows).join(profiles.filter("available"), "app_id").join(apps, "app_id", "left")

    def shown(column):
        # A column the app table lacks is unknown for every app.
        if column not in apps.columns:
            return F.lit("—")
        return F.coalesce(F.replace(F.col(column).cast("string"), F.lit("|"), F.lit("/")), F.lit("—"))

    name = F.coalesce("app_name", "app_id") if "app_name" in apps.columns else F.col("app_id")
    return listed.select(
        "own_id", "position",
        F.when(F.col("position") == 0, F.concat(name, F.lit(" (ours)"))).otherwise(name).alias("product"),
        F.col("sample_size").alias("reviews"),
        F.col("average_rating").alias("sample_rating"),
        shown("score").alias("store_rating"),
        shown("ratings").alias("store_ratings"),
        shown("installs").alias("downloads"),
        shown("genre").alias("category"),
        shown("developer").alias("developer"),
        shown("updated").alias("updated"),
        shown("size").alias("size"),
        F.col("positive_rate").alias("positive"),
        F.col("praise_rate").alias("praise"),
        F.col("issue_rate").alias("issues"),
    )
