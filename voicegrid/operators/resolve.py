"""Finding the app a name stands for, and the competitors of an app.

Lookup sides carry no broadcast hints: Spark broadcasts them when their measured
size allows it and shuffles them otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voicegrid import config
from voicegrid.functions import numeric, text


def alias_table(spark: SparkSession, mapping: dict[str, str] | None = None) -> DataFrame:
    rows = list((mapping or config.VERIFIED_APP_IDS).items())
    return spark.createDataFrame(rows, "alias string, alias_id string")


def competitor_table(spark: SparkSession, mapping: dict | None = None) -> DataFrame:
    rows = [(name, list(rivals)) for name, rivals in (mapping or config.COMPETITORS).items()]
    return spark.createDataFrame(rows, "app_key string, competitors array<string>")


def verified_table(spark: SparkSession, mapping: dict[str, str] | None = None) -> DataFrame:
    """Confirmed competitor ids with the note some of them carry."""
    rows = [
        (name, app_id, config.COMPETITOR_NOTES.get(name))
        for name, app_id in (mapping or config.VERIFIED_COMPETITOR_IDS).items()
    ]
    return spark.createDataFrame(rows, "name_key string, verified_id string, note string")


def usable(candidates: DataFrame) -> DataFrame:
    """Search results that carry an id."""
    return candidates.filter(F.col("candidate_id").isNotNull() & (F.col("candidate_id") != ""))


def by_alias(requests: DataFrame, aliases: DataFrame) -> DataFrame:
    """Requests whose name is a known alias."""
    return requests.join(aliases, text.normalize(F.col("app_name")) == F.col("alias")).select(
        *[requests[c] for c in requests.columns],
        F.col("alias_id").alias("app_id"),
        F.col("app_name").alias("title"),
        F.lit(1.0).alias("confidence"),
    )


def without_alias(requests: DataFrame, aliases: DataFrame) -> DataFrame:
    return requests.join(aliases, text.normalize(F.col("app_name")) == F.col("alias"), "left_anti")


def by_exact_title(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per searched name the best-ranked candidate with exactly that title."""
    best = (
        usable(candidates)
        .filter(F.lower("title") == F.lower("search_name"))
        .groupBy("search_name")
        .agg(F.min_by(F.struct("candidate_id", "title"), "search_rank").alias("best"))
    )
    return requests.join(best, F.col("app_name") == F.col("search_name")).select(
        *[requests[c] for c in requests.columns],
        F.col("best.candidate_id").alias("app_id"),
        F.col("best.title").alias("title"),
        F.lit(1.0).alias("confidence"),
    )


def ambiguous(requests: DataFrame, candidates: DataFrame, shown: int = 5) -> DataFrame:
    """First candidates of every name that has candidates but no exact title."""
    valid = usable(candidates)
    exact = valid.filter(F.lower("title") == F.lower("search_name")).select("search_name").distinct()
    rank = F.row_number().over(W.partitionBy("search_name").orderBy("search_rank", "candidate_id"))
    listed = (
        valid.join(exact, "search_name", "left_anti")
        .withColumn("position", rank)
        .filter(F.col("position") <= shown)
        .select(
            "search_name", "position",
            F.col("candidate_id").alias("app_id"),
            F.coalesce("title", "candidate_id").alias("title"),
        )
    )
    return requests.join(listed, F.col("app_name") == F.col("search_name")).drop("search_name")


def not_found(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    names = usable(candidates).select("search_name")
    return requests.join(names, F.col("app_name") == F.col("search_name"), "left_anti").withColumn(
        "reason", F.lit("No app found")
    )


def resolve_apps(requests: DataFrame, aliases: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per resolved request; names that stay open get a reason and no id."""
    open_requests = without_alias(requests, aliases)
    exact = by_exact_title(open_requests, candidates)
    names = ambiguous(open_requests, candidates).groupBy(*requests.columns).agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("position", "title", "app_id"))),
                lambda c: F.format_string("%s (%s)", c["title"], c["app_id"]),
            ),
            ", ",
        ).alias("listing")
    )
    unclear = names.withColumn(
        "reason",
        F.format_string("Could not identify '%s' exactly. Candidates: %s", F.col("app_name"), F.col("listing")),
    ).drop("listing")
    resolved = by_alias(requests, aliases).unionByName(exact)
    return resolved.unionByName(unclear, allowMissingColumns=True).unionByName(
        not_found(open_requests, candidates), allowMissingColumns=True
    )


def resolve_competitors(candidates: DataFrame) -> DataFrame:
    """Best candidate per name: exact title first, then most installs, then search order."""
    ranked = usable(candidates).withColumns({
        "exact": text.casefold(F.coalesce("title", F.lit(""))) == text.casefold(F.col("search_name")),
        "install_count": numeric.parse_installs(F.col("installs")),
    })
    preference = F.struct("exact", "install_count", -F.col("search_rank"))
    return (
        ranked.groupBy("search_name")
        .agg(F.max_by(F.struct("candidate_id", "title", "exact"), preference).alias("best"))
        .select(
            F.col("search_name").alias("competitor"),
            F.col("best.candidate_id").alias("resolved_id"),
            F.col("best.title").alias("resolved_title"),
            F.when(F.col("best.exact"), 0.8).otherwise(0.5).alias("confidence"),
        )
    )


def expand_competitors(apps: DataFrame, table: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per (app, competitor); unknown apps give no row."""
    rivals = F.col("competitors") if limit is None else F.slice("competitors", 1, limit)
    return apps.join(table, text.normalize(F.col("app_name")) == F.col("app_key")).select(
        *[apps[c] for c in apps.columns], F.posexplode(rivals).alias("position", "competitor")
    )


def competitor_records(expanded: DataFrame, verified: DataFrame) -> DataFrame:
    """Where each competitor comes from and whether its id is confirmed."""
    joined = expanded.join(verified, text.casefold(F.col("competitor")) == F.col("name_key"), "left")
    return joined.select(
        *[expanded[c] for c in expanded.columns],
        F.lit("offline_seed_dictionary").alias("source"),
        F.col("verified_id").alias("competitor_id"),
        F.col("verified_id").isNotNull().alias("verified"),
        F.col("verified_id").isNull().alias("verification_required"),
        F.col("note").alias("resolution_note"),
    )


def with_resolution(records: DataFrame, resolved: DataFrame) -> DataFrame:
    """Fill the id of unconfirmed competitors from the search and say so in the note."""
    chosen = resolved.select(F.col("competitor").alias("_name"), "resolved_id", "resolved_title")
    note = F.format_string(
        "Resolved automatically to %s (%s); selected by exact title or highest Play Store installs.",
        F.col("resolved_title"), F.col("resolved_id"),
    )
    automatic = F.col("competitor_id").isNull() & F.col("resolved_id").isNotNull()
    return (
        records.join(chosen, F.col("competitor") == F.col("_name"), "left")
        .withColumn("resolution_note", F.when(automatic, note).otherwise(F.col("resolution_note")))
        .withColumn("competitor_id", F.coalesce("competitor_id", "resolved_id"))
        .drop("_name", "resolved_id", "resolved_title")
    )


def verify_unique(records: DataFrame, candidates: DataFrame) -> DataFrame:
    """Unconfirmed competitors need exactly one exact-title match."""
    matches = (
        usable(candidates)
        .filter(text.casefold(F.coalesce("title", F.lit(""))) == text.casefold(F.col("search_name")))
        .groupBy("search_name")
        .agg(F.count("*").alias("matches"), F.min("candidate_id").alias("only_id"))
    )
    found = F.coalesce("matches", F.lit(0))
    confirmed = F.col("competitor_id").isNotNull()
    return (
        records.join(matches, F.col("competitor") == F.col("search_name"), "left")
        .withColumns({
            "matched_id": F.coalesce("competitor_id", F.when(found == 1, F.col("only_id"))),
            "reason": F.when(
                ~confirmed & (found != 1), F.format_string("Expected one exact match; found %d", found)
            ),
        })
        .drop("search_name", "matches", "only_id")
    )


def verify_title(records: DataFrame, details: DataFrame) -> DataFrame:
    """The title of the package must begin with the competitor's name."""
    titles = details.select(F.col("app_id").alias("_id"), F.col("title").alias("package_title"))
    title = F.coalesce("package_title", F.lit(""))
    agrees = F.startswith(text.casefold(title), text.casefold(F.col("competitor")))
    return (
        records.join(titles, F.col("matched_id") == F.col("_id"), "left")
        .withColumn(
            "reason",
            F.coalesce("reason", F.when(~agrees, F.format_string("Package title mismatch: %s", "package_title"))),
        )
        .withColumn("verified", F.col("reason").isNull())
        .drop("_id")
    )


def matched_samples(reviews: DataFrame, apps: DataFrame, count: int) -> DataFrame:
    """The same number of newest reviews for every app of the comparison."""
    from voicegrid.operators.intake import latest_reviews

    wanted = reviews.join(apps.select("app_id").distinct(), "app_id", "left_semi")
    return latest_reviews(wanted, count)


def skipped_competitors(records: DataFrame, reviews: DataFrame, reason: str = "No reviews returned") -> DataFrame:
    """Competitors without a single review; the others go on."""
    collected = reviews.select(F.col("app_id").alias("competitor_id")).distinct()
    return records.join(collected, "competitor_id", "left_anti").withColumn("reason", F.lit(reason))


def first_app_id(reviews: DataFrame, key: str = "app_name", seq: str = "review_seq") -> DataFrame:
    """Store id of the first collected row per app name."""
    return reviews.groupBy(key).agg(F.min_by("app_id", seq).alias("app_id"))


def attach_metadata(rows: DataFrame, apps: DataFrame, on: str = "app_name") -> DataFrame:
    return rows.join(apps, on, "left")
