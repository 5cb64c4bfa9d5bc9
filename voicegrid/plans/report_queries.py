"""Catalogue: summaries, profiles, themes, comparison, evidence and the run ledger."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voicegrid.config import CONFIDENCE_BINS, ISSUE_CATEGORIES, RATE_CATEGORIES
from voicegrid.functions import numeric, text
from voicegrid.operators import classify, compete, evidence, ledger, priority, search_index, summary
from voicegrid.operators.sentiment import add_sentiment
from voicegrid.plans.model_queries import PRIORITY_CTE, exact_groups
from voicegrid.plans.registry import query
from voicegrid.plans.text_queries import BIN_SQL, SENTIMENT_CTE, text_query
from voicegrid.sources.samples import NEGATIVE, POSITIVE, STOPWORDS, TOPICS, Tables

# --- analyzed reviews ------------------------------------------------------------

ANALYZED_CTE = f"""{SENTIMENT_CTE}, {PRIORITY_CTE}, analyzed AS (SELECT s.*, priority, priority_score,
 s.prediction_confidence < 0.6 AS needs_human_review,
 s.prediction_confidence < 0.6 AND s.vocabulary_hits <> 0 AS requires_llm_review,
 CASE WHEN s.prediction_confidence < 0.6 AND s.vocabulary_hits = 0 THEN 'translation_or_human'
 WHEN s.prediction_confidence < 0.6 THEN 'llm_ambiguity' ELSE 'model_confident' END AS review_route
 FROM spoken s JOIN prioritized p ON s.review_seq = p.review_seq)"""
SPOKEN_CTE = f"""{SENTIMENT_CTE}, analyzed AS (SELECT *, prediction_confidence < 0.6 AS needs_human_review,
 prediction_confidence < 0.6 AND vocabulary_hits <> 0 AS requires_llm_review,
 CASE WHEN prediction_confidence < 0.6 AND vocabulary_hits = 0 THEN 'translation_or_human'
 WHEN prediction_confidence < 0.6 THEN 'llm_ambiguity' ELSE 'model_confident' END AS review_route FROM spoken)"""


def spoken(t: Tables):
    """Routed reviews with sentiment."""
    return add_sentiment(classify.route(t.reviews()), POSITIVE, NEGATIVE)


def analyzed(t: Tables):
    """Routed reviews with sentiment, exact-copy groups and priority."""
    return add_sentiment(classify.route(priority.add_priority(exact_groups(t))), POSITIVE, NEGATIVE)


@query(
    "sum_totals", reviews=True, ctes=SPOKEN_CTE,
    sql="""SELECT count(*) AS total_reviews, round_even(avg(rating) * 100, 0) / 100 AS average_rating,
 count(*) FILTER (needs_human_review) AS low_confidence_reviews,
 round_even(avg(prediction_confidence) * 1000, 0) / 1000 AS average_confidence FROM analyzed""",
)
def sum_totals(t: Tables):
    return summary.totals(spoken(t))


def count_query(name: str, column: str, build_rows, cte: str):
    @query(
        name, reviews=True, ctes=cte,
        sql=f"SELECT {column}, count(*) AS reviews FROM analyzed WHERE {column} IS NOT NULL GROUP BY {column}",
    )
    def build(t: Tables):
        return summary.value_counts(build_rows(t), column)

    return build


count_query("sum_category", "category", spoken, SPOKEN_CTE)
count_query("sum_sentiment", "sentiment", spoken, SPOKEN_CTE)
count_query("sum_priority", "priority", analyzed, ANALYZED_CTE)


@query(
    "sum_distributions", reviews=True, ctes=ANALYZED_CTE,
    sql=" UNION ALL ".join(
        f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS reviews FROM analyzed GROUP BY {c}" for c in summary.DIMENSIONS
    ),
)
def sum_distributions(t: Tables):
    """The three distributions of a summary in one pass."""
    return summary.distributions(analyzed(t))


@query(
    "sum_distributions_by_app", reviews=True, ctes=ANALYZED_CTE,
    sql=" UNION ALL ".join(
        f"SELECT app_id, '{c}' AS dimension, {c} AS value, count(*) AS reviews FROM analyzed GROUP BY app_id, {c}" for c in summary.DIMENSIONS
    ),
)
def sum_distributions_by_app(t: Tables):
    """The three distributions of every app's summary in one pass."""
    return summary.distributions(analyzed(t), keys=["app_id"])


@query(
    "sum_diagnostics_by_app", reviews=True, ctes=SPOKEN_CTE,
    sql="""SELECT app_id, round_even(min(prediction_confidence) * 1000, 0) / 1000 AS minimum,
 round_even(max(prediction_confidence) * 1000, 0) / 1000 AS maximum, round_even(avg(prediction_confidence) * 1000, 0) / 1000 AS mean,
 count(*) FILTER (requires_llm_review) AS llm_ambiguity_reviews,
 count(*) FILTER (review_route = 'translation_or_human') AS translation_or_human_reviews FROM analyzed GROUP BY app_id""",
)
def sum_diagnostics_by_app(t: Tables):
    """Confidence and open routes of every app's summary."""
    rows = spoken(t)
    return summary.confidence_diagnostics(rows, keys=["app_id"]).join(summary.route_counts(rows, ["app_id"]), "app_id")


# Every source is an own app, with the next two sources as its competitors; the last has none.
RUN_CTE = """ids AS (SELECT DISTINCT source AS app_id FROM documents WHERE source IS NOT NULL),
 numbered AS (SELECT app_id, row_number() OVER (ORDER BY app_id) AS n FROM ids),
 sampled AS (SELECT * FROM dated WHERE app_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY app_id
 ORDER BY review_date DESC NULLS LAST, review_seq) <= 1000)"""


@query(
    "run_summary", dated=True, ctes=RUN_CTE,
    sql="""SELECT app_id, count(*) AS total_reviews, round_even(avg(rating) * 100, 0) / 100 AS average_rating,
 count(*) FILTER (prediction_confidence < 0.6) AS low_confidence_reviews,
 round_even(avg(prediction_confidence) * 1000, 0) / 1000 AS average_confidence,
 (SELECT count(*) FROM numbered b WHERE b.n IN (a.n + 1, a.n + 2)) AS competitors
 FROM sampled JOIN numbered a USING (app_id) GROUP BY app_id, a.n""",
)
def run_summary(t: Tables):
    """The whole run over all apps: its summary per app, and how many competitors each was compared with."""
    from voicegrid.plans import pipeline

    ids = t.documents.select(F.col("source").alias("app_id")).dropna().distinct()
    spans = ids.select("app_id", F.row_number().over(W.orderBy("app_id")).alias("n"))
    after = spans.select(F.col("app_id").alias("competitor_id"), F.col("n").alias("m"))
    ahead = spans.select(F.col("app_id").alias("own_id"), F.explode(F.array(F.col("n") + 1, F.col("n") + 2)).alias("m"), "n")
    pairs = ahead.join(after, "m").select("own_id", "competitor_id", (F.col("m") - F.col("n") - 1).alias("position"))
    result = pipeline.run("run-1", classify.route(t.dated()), pairs, ids, own_apps=ids)
    compared = result.market_position.select(F.col("own_id").alias("app_id"), (F.col("out_of") - 1).alias("competitors"))
    return result.summary.join(compared, "app_id")


@query(
    "sum_conf_diag", reviews=True,
    sql="""SELECT round_even(min(prediction_confidence) * 1000, 0) / 1000 AS minimum,
 round_even(max(prediction_confidence) * 1000, 0) / 1000 AS maximum,
 round_even(avg(prediction_confidence) * 1000, 0) / 1000 AS mean FROM reviews""",
)
def sum_conf_diag(t: Tables):
    return summary.confidence_diagnostics(t.reviews())


_BINS = ", ".join(f"({i}, '{label}')" for i, (_, label) in enumerate(CONFIDENCE_BINS))


@query(
    "sum_conf_hist", reviews=True,
    sql=f"""SELECT position, b.bin, count(review_seq) AS reviews FROM (VALUES {_BINS}) b(position, bin)
 LEFT JOIN reviews ON b.bin = {BIN_SQL.format('prediction_confidence')} GROUP BY ALL""",
)
def sum_conf_hist(t: Tables):
    return summary.confidence_histogram(t.reviews())


@query(
    "sum_route_counts", reviews=True, ctes=SPOKEN_CTE,
    sql="""SELECT count(*) FILTER (requires_llm_review) AS llm_ambiguity_reviews,
 count(*) FILTER (review_route = 'translation_or_human') AS translation_or_human_reviews FROM analyzed""",
)
def sum_route_counts(t: Tables):
    return summary.route_counts(spoken(t))


_NULL_COLUMNS = ("review_seq", "app_id", "review_text", "rating", "thumbs_up", "category", "prediction_confidence",
                 "vocabulary_hits", "review_date", "reply_text")


@query(
    "prof_nulls", dated=True,
    sql=" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS nulls FROM dated" for c in _NULL_COLUMNS),
)
def prof_nulls(t: Tables):
    return summary.null_counts(t.dated())


@query("prof_shape", reviews=True, sql="SELECT count(*) AS rows, 8 AS columns FROM reviews")
def prof_shape(t: Tables):
    return summary.shape(t.reviews())


@query("prof_head", reviews=True, sql="SELECT review_seq, app_id, category FROM reviews ORDER BY review_seq LIMIT 20")
def prof_head(t: Tables):
    return summary.head(t.reviews(), 20).select("review_seq", "app_id", "category")


@query(
    "app_report", reviews=True,
    sql="""SELECT category, count(*) AS reviews, (SELECT count(*) FROM reviews WHERE app_id = 'src3')::BIGINT AS total_reviews,
 (SELECT round_even(avg(rating) * 100, 0) / 100 FROM reviews WHERE app_id = 'src3') AS average_rating
 FROM reviews WHERE app_id = 'src3' GROUP BY category""",
)
def app_report(t: Tables):
    return summary.app_report(t.reviews(), "SRC3", "app_id")


@query(
    "app_samples", reviews=True,
    sql="SELECT review_seq, review_text FROM reviews WHERE category = 'Complaint' ORDER BY review_seq LIMIT 10",
)
def app_samples(t: Tables):
    return summary.category_samples(t.reviews(), "Complaint", 10, column="review_text")


# --- profiles --------------------------------------------------------------------

_VALID = "len(regexp_extract_all(review_text, '[A-Za-z]{2,}')) >= 2"
_ISSUES = ", ".join(f"'{c}'" for c in ISSUE_CATEGORIES)


def _share(condition: str) -> str:
    return f"""coalesce(round_even(sum(CASE WHEN valid AND {condition} THEN prediction_confidence ELSE 0 END)
 / nullif(sum(CASE WHEN valid THEN prediction_confidence ELSE 0 END), 0) * 1000, 0) / 10, 0)"""


PROFILE_CTE = f"""{SPOKEN_CTE}, marked AS (SELECT *, {_VALID} AS valid FROM analyzed),
 profiles AS (SELECT app_id, count(*) AS sample_size, count(*) FILTER (valid) AS interpretable_reviews,
 count(*) FILTER (NOT valid) AS uninterpretable_reviews, count(*) FILTER (needs_human_review) AS queued_reviews,
 coalesce(round_even(avg(rating) * 100, 0) / 100, 0) AS average_rating,
 coalesce(round_even(avg((sentiment = 'Positive')::INTEGER) FILTER (valid) * 1000, 0) / 10, 0) AS positive_rate,
 coalesce(round_even(avg((sentiment = 'Negative')::INTEGER) FILTER (valid) * 1000, 0) / 10, 0) AS negative_rate,
 {_share("category = 'Praise'")} AS praise_rate, {_share(f"category IN ({_ISSUES})")} AS issue_rate,
 coalesce(round_even(avg(prediction_confidence) FILTER (valid) * 1000, 0) / 10, 0) AS confidence_coverage,
 {', '.join(f"{_share(f'category = {c!r}')} AS rate_{i}" for i, c in enumerate(RATE_CATEGORIES))}
 FROM marked GROUP BY app_id)"""


def profiles(t: Tables):
    return compete.rates(compete.measured(spoken(t), TOPICS))


def profile_query(name: str, *columns: str):
    @query(name, reviews=True, ctes=PROFILE_CTE, sql=f"SELECT app_id, {', '.join(columns)} FROM profiles")
    def build(t: Tables):
        return profiles(t).select("app_id", *columns)

    return build


profile_query("prof_sample_size", "sample_size")
profile_query("prof_interpretable", "interpretable_reviews", "uninterpretable_reviews")
profile_query("prof_queued", "queued_reviews")
profile_query("prof_avg_rating", "average_rating")
profile_query("prof_sentiment_rates", "positive_rate", "negative_rate")
profile_query("prof_conf_coverage", "confidence_coverage")


@query(
    "prof_weighted_rates", reviews=True, ctes=PROFILE_CTE,
    sql="SELECT app_id, praise_rate, issue_rate, rate_0, rate_1, rate_2, rate_3, rate_4 FROM profiles",
)
def prof_weighted_rates(t: Tables):
    return profiles(t).select(
        "app_id", "praise_rate", "issue_rate",
        *[F.col("category_rates")[label].alias(f"rate_{i}") for i, label in enumerate(RATE_CATEGORIES)],
    )


@query(
    "prof_empty", reviews=True,
    sql="""SELECT app_id, count(review_seq) > 0 AS available, count(review_seq) AS sample_size FROM
 (SELECT 'src' || n_nationkey AS app_id FROM nation) LEFT JOIN reviews USING (app_id) GROUP BY app_id""",
)
def prof_empty(t: Tables):
    apps = t.nation.selectExpr("concat('src', n_nationkey) AS app_id")
    return compete.with_unavailable(profiles(t), apps).select("app_id", "available", "sample_size")


@query(
    "rep_quality", reviews=True, ctes=PROFILE_CTE,
    sql="""SELECT app_id, sample_size, queued_reviews, round_even(queued_reviews / sample_size * 1000, 0) / 10 AS queued_share,
 uninterpretable_reviews, round_even(uninterpretable_reviews / sample_size * 1000, 0) / 10 AS uninterpretable_share FROM profiles""",
)
def rep_quality(t: Tables):
    return summary.queue_quality(spoken(t), ["app_id"])


# --- themes ----------------------------------------------------------------------

_HITS = ", ".join(
    f"count(*) FILTER (regexp_matches(replace(lower(review_text), 'ß', 'ss'), '{p}')) AS topic_{i}" for i, p in enumerate(TOPICS.values())
)
_LISTED = ", ".join(f"{{'position': {i}, 'theme': '{n}', 'reviews': topic_{i}}}" for i, n in enumerate(TOPICS))
THEME_CTE = f"""{SPOKEN_CTE}, subsets AS (SELECT app_id, 'praise' AS subset, review_text FROM analyzed
 WHERE sentiment = 'Positive' OR category = 'Praise' UNION ALL
 SELECT app_id, 'issue', review_text FROM analyzed WHERE category IN ({_ISSUES})),
 hit_counts AS (SELECT app_id, subset, count(*) AS subset_size, {_HITS} FROM subsets GROUP BY app_id, subset),
 themes AS (SELECT app_id, subset, subset_size, unnest([{_LISTED}], recursive := true) FROM hit_counts),
 supported AS (SELECT * FROM themes WHERE reviews >= greatest(3, floor(subset_size * 0.01 + 0.999))),
 ranked_themes AS (SELECT *, CAST(row_number() OVER (PARTITION BY app_id, subset ORDER BY reviews DESC, position) AS INTEGER)
 AS rank, round_even(reviews / subset_size * 1000, 0) / 10 AS percentage FROM supported)"""


def theme_counts(t: Tables):
    return compete.theme_counts(compete.measured(spoken(t), TOPICS), TOPICS)


@query(
    "thm_match", reviews=True, ctes=THEME_CTE, sql="SELECT app_id, subset, subset_size, position, theme, reviews FROM themes",
)
def thm_match(t: Tables):
    return theme_counts(t).select("app_id", "subset", "subset_size", F.inline("entries"))


@query(
    "thm_support", reviews=True, ctes=THEME_CTE,
    sql="SELECT app_id, subset, subset_size, rank, theme, reviews, percentage FROM ranked_themes",
)
def thm_support(t: Tables):
    return compete.top_themes(theme_counts(t), None)


@query(
    "thm_top_k", reviews=True, ctes=THEME_CTE,
    sql="SELECT app_id, subset, subset_size, rank, theme, reviews, percentage FROM ranked_themes WHERE rank <= 5",
)
def thm_top_k(t: Tables):
    return compete.top_themes(theme_counts(t))


def subset_query(name: str, subset: str):
    @query(
        name, reviews=True, ctes=THEME_CTE,
        sql=f"SELECT app_id, rank, theme, reviews, percentage FROM ranked_themes WHERE rank <= 5 AND subset = '{subset}'",
    )
    def build(t: Tables):
        best = compete.top_themes(theme_counts(t).filter(F.col("subset") == subset))
        return best.select("app_id", "rank", "theme", "reviews", "percentage")

    return build


subset_query("thm_praise", "praise")
subset_query("thm_issue", "issue")


# --- comparison ------------------------------------------------------------------
# An app competes with the apps of the nations in its region.

PAIR_CTE = f"""{PROFILE_CTE}, pairs AS (SELECT 'src' || a.n_nationkey AS own_id, 'src' || b.n_nationkey AS competitor_id,
 CAST(row_number() OVER (PARTITION BY a.n_nationkey ORDER BY b.n_nationkey) - 1 AS INTEGER) AS position FROM nation a
 JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey),
 joined AS (SELECT own_id, competitor_id, o.average_rating AS own_rating, c.average_rating AS rival_rating,
 o.positive_rate AS own_positive, c.positive_rate AS rival_positive, o.praise_rate AS own_praise, c.praise_rate AS rival_praise,
 o.issue_rate AS own_issue, c.issue_rate AS rival_issue FROM pairs JOIN profiles o ON o.app_id = own_id
 JOIN profiles c ON c.app_id = competitor_id),
 deltas AS (SELECT own_id, competitor_id, 0 AS metric_no, 'average rating' AS metric, own_rating - rival_rating AS delta,
 TRUE AS higher, 0.05::DOUBLE AS least FROM joined
 UNION ALL SELECT own_id, competitor_id, 1, 'positive-feedback rate', own_positive - rival_positive, TRUE, 1.0 FROM joined
 UNION ALL SELECT own_id, competitor_id, 2, 'confidence-weighted praise rate', own_praise - rival_praise, TRUE, 1.0 FROM joined
 UNION ALL SELECT own_id, competitor_id, 3, 'confidence-weighted issue rate', own_issue - rival_issue, FALSE, 1.0 FROM joined)"""


def pairs(t: Tables):
    other = t.nation.select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("rival"))
    mates = t.nation.join(other, F.col("n_regionkey") == F.col("r")).filter("rival <> n_nationkey")
    listed = mates.groupBy("n_nationkey").agg(F.sort_array(F.collect_list("rival")).alias("rivals"))
    return listed.select("n_nationkey", F.posexplode("rivals").alias("position", "rival")).select(
        F.concat(F.lit("src"), "n_nationkey").alias("own_id"), F.concat(F.lit("src"), "rival").alias("competitor_id"), "position"
    )


def available(t: Tables):
    return profiles(t)


@query(
    "cmp_deltas", reviews=True, ctes=PAIR_CTE,
    sql="SELECT own_id, competitor_id, metric_no, metric, round(delta, 6) AS delta FROM deltas",
)
def cmp_deltas(t: Tables):
    rows = compete.deltas(compete.paired(available(t), pairs(t)))
    return rows.select("own_id", "competitor_id", "metric_no", "metric", F.round("delta", 6).alias("delta"))


@query(
    "cmp_material", reviews=True, ctes=PAIR_CTE,
    sql="""SELECT own_id, competitor_id, coalesce(string_agg(metric, ', ' ORDER BY metric_no)
 FILTER (abs(delta) >= least AND (delta > 0) = higher), '') AS our_advantages,
 coalesce(string_agg(metric, ', ' ORDER BY metric_no) FILTER (abs(delta) >= least AND (delta > 0) <> higher), '') AS our_gaps
 FROM deltas GROUP BY own_id, competitor_id""",
)
def cmp_material(t: Tables):
    rows = compete.comparisons(compete.deltas(compete.paired(available(t), pairs(t))))
    return rows.withColumns({c: F.array_join(c, ", ") for c in ("our_advantages", "our_gaps")})


@query(
    "cmp_rank", reviews=True, ctes=PAIR_CTE,
    sql="""SELECT own_id, CASE WHEN count(competitor_id) > 0 THEN 1 + count(*) FILTER (rival_rating > own_rating
 OR (rival_rating = own_rating AND rival_positive > own_positive)) END AS rank, count(competitor_id) + 1 AS out_of
 FROM (SELECT DISTINCT own_id FROM pairs) LEFT JOIN joined USING (own_id) GROUP BY own_id""",
)
def cmp_rank(t: Tables):
    return compete.market_position(available(t), pairs(t))


@query(
    "rep_competitor_table", reviews=True, ctes=f"""{PAIR_CTE}, meta AS (SELECT 'src' || (n_nationkey * 2) AS app_id,
 CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_name || '|x' END AS developer, n_name AS app_name, n_regionkey AS ratings FROM nation),
 listed AS (SELECT DISTINCT own_id, own_id AS app_id, 0 AS position FROM pairs
 UNION ALL SELECT own_id, competitor_id, position + 1 FROM pairs)""",
    sql="""SELECT own_id, position, coalesce(app_name, p.app_id) || CASE WHEN position = 0 THEN ' (ours)' ELSE '' END AS product,
 sample_size AS reviews, average_rating AS sample_rating, '—' AS store_rating, coalesce(ratings::VARCHAR, '—') AS store_ratings,
 '—' AS downloads, '—' AS category, coalesce(replace(developer, '|', '/'), '—') AS developer, '—' AS updated, '—' AS size,
 positive_rate AS positive, praise_rate AS praise, issue_rate AS issues FROM listed JOIN profiles p USING (app_id)
 LEFT JOIN meta m ON m.app_id = p.app_id""",
)
def rep_competitor_table(t: Tables):
    meta = t.nation.selectExpr(
        "concat('src', n_nationkey * 2) AS app_id",
        "CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE concat(n_name, '|x') END AS developer",
        "n_name AS app_name", "n_regionkey AS ratings",
    )
    return compete.competitor_table(available(t), pairs(t), meta)


# --- evidence --------------------------------------------------------------------

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
CHUNK_CTE = f"""pieces AS (SELECT 'page' || page_id AS source, CAST(i - 1 AS INTEGER) AS chunk, trim(parts[i], {_SPACE}) AS text
 FROM (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM
 (SELECT page_id, string_split(html, '</p>') AS parts FROM pages))),
 chunks AS (SELECT *, sha256(source || ':' || chunk) AS id FROM pieces WHERE length(text) >= 20)"""


def page_documents(t: Tables):
    return t.pages.selectExpr("concat('page', page_id) AS source", "html AS text")


def chunks(t: Tables):
    return evidence.chunk(page_documents(t), "</p>")


@query("rag_chunk", ctes=CHUNK_CTE, sql="SELECT source, chunk, id, md5(text) AS digest FROM chunks")
def rag_chunk(t: Tables):
    return chunks(t).select("source", "chunk", "id", F.md5("text").alias("digest"))


@query("rag_chunk_all", ctes=CHUNK_CTE, sql="SELECT source, chunk, md5(text) AS digest FROM pieces WHERE text <> ''")
def rag_chunk_all(t: Tables):
    return evidence.chunk_all(page_documents(t), "</p>").select("source", "chunk", F.md5("text").alias("digest"))


text_query("flt_min_chunk", lambda: F.char_length(text.strip(F.col("review_text"))) >= 20, "length(trim(review_text)) >= 20")


@query(
    "rag_upsert", ctes=CHUNK_CTE,
    sql="""SELECT id, source, chunk, md5(CASE WHEN chunk % 2 = 0 THEN 'new ' || text ELSE text END) AS digest FROM chunks""",
)
def rag_upsert(t: Tables):
    """Chunks stored twice, every second one changed: one row per id remains."""
    stored = chunks(t)
    again = stored.filter("chunk % 2 = 0").withColumn("text", F.concat(F.lit("new "), "text"))
    return evidence.upsert(stored, again).select("id", "source", "chunk", F.md5("text").alias("digest"))


@query(
    "rag_topk_vector", ctes="asked AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)",
    sql="""SELECT vec_id, round_even(least(greatest(cosine, 0), 1) * 10000, 0) / 10000 AS score FROM (SELECT vec_id,
 list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) AS cosine FROM embeddings, asked WHERE vec_id <> 0)
 ORDER BY round(cosine, 12) DESC, vec_id LIMIT 6""",
)
def rag_topk_vector(t: Tables):
    question = t.embeddings.filter("vec_id = 0").select("embedding").scalar()
    corpus = t.embeddings.filter("vec_id <> 0").select("vec_id", "embedding")
    return evidence.top_k_vector(corpus, question, key="vec_id").select("vec_id", "score")


QUESTION = "that this with competitors product features for was thaner"
_ASKED = "['" + "', '".join(QUESTION.split()) + "']"
_NOT_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
RETRIEVE_CTE = rf"""corpus AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}') AS tokens FROM documents
 UNION ALL SELECT -1, {_ASKED}),
 counted AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(tokens) AS term FROM corpus)
 WHERE term NOT IN ({_NOT_STOP}) GROUP BY ALL),
 idfs AS (SELECT term, ln((1.0 + (SELECT count(*) FROM corpus)) / (1.0 + count(*))) + 1.0 AS idf FROM counted GROUP BY term),
 weighted AS (SELECT id, term, tf * idf AS w FROM counted JOIN idfs USING (term)),
 unit AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM weighted),
 scores AS (SELECT d.id, sum(d.w * q.w) AS cosine FROM unit d JOIN unit q ON d.term = q.term AND q.id = -1 AND d.id <> -1 GROUP BY d.id)"""


@query(
    "rag_topk_tfidf", ctes=RETRIEVE_CTE,
    sql="""SELECT id, round_even(cosine * 10000, 0) / 10000 AS score FROM scores WHERE cosine > 0
 ORDER BY round(cosine, 12) DESC, id LIMIT 6""",
)
def rag_topk_tfidf(t: Tables):
    corpus = t.documents.select(F.col("doc_id").alias("id"), "text")
    return evidence.top_k_tfidf(corpus, QUESTION, stopwords=STOPWORDS).select("id", "score")


@query(
    "flt_positive_score", ctes=RETRIEVE_CTE,
    sql="SELECT id, round_even(cosine * 10000, 0) / 10000 AS score FROM scores WHERE cosine > 0",
)
def flt_positive_score(t: Tables):
    """Every document with a score above 0."""
    corpus = t.documents.select(F.col("doc_id").alias("id"), "text")
    return evidence.tfidf_scores(corpus, QUESTION, stopwords=STOPWORDS).select(
        "id", numeric.round_even(F.col("cosine"), 4).alias("score")
    )


# The first turns of conversations are asked, each of the documents of one source.
SEARCH_CTE = rf"""chunk AS (SELECT doc_id AS id, source AS app_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'),
 lambda t: t NOT IN ({_NOT_STOP})) AS tokens FROM documents WHERE source IS NOT NULL),
 sizes AS (SELECT app_id, count(*) + 1.0::DOUBLE AS n FROM chunk GROUP BY app_id),
 bag AS (SELECT app_id, id, term, count(*) AS tf FROM (SELECT app_id, id, unnest(tokens) AS term FROM chunk) GROUP BY ALL),
 stats AS (SELECT app_id, term, count(*) AS df FROM bag GROUP BY ALL),
 ask AS (SELECT 'src' || (conv_id % 20) AS app_id, conv_id AS question_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}') AS tokens
 FROM conversations WHERE turn = 1),
 qbag AS (SELECT app_id, question_id, term, count(*) AS qtf FROM (SELECT app_id, question_id, unnest(tokens) AS term FROM ask)
 WHERE term NOT IN ({_NOT_STOP}) GROUP BY ALL),
 qw AS (SELECT app_id, question_id, term, qtf * (ln((1 + n) / (2 + coalesce(df, 0))) + 1) AS qw FROM qbag JOIN sizes USING (app_id)
 LEFT JOIN stats USING (app_id, term)),
 qn AS (SELECT app_id, question_id, sqrt(sum(qw * qw)) AS ql FROM qw GROUP BY ALL),
 dw AS (SELECT app_id, id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS idle, tf * (ln((1 + n) / (2 + df)) + 1) AS asked
 FROM bag JOIN stats USING (app_id, term) JOIN sizes USING (app_id)),
 dn AS (SELECT app_id, id, sum(idle * idle) AS squares FROM dw GROUP BY ALL),
 hit AS (SELECT app_id, question_id, id, sum(qw * asked) AS dot, sum(idle * idle - asked * asked) AS less FROM dw JOIN qw USING (app_id, term)
 GROUP BY ALL),
 scored AS (SELECT app_id, question_id, id, dot / ql / sqrt(squares - less) AS cosine FROM hit JOIN dn USING (app_id, id)
 JOIN qn USING (app_id, question_id)),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY app_id, question_id ORDER BY round(cosine, 12) DESC, id)::INT AS rank FROM scored)"""


@query(
    "rag_topk_many", ctes=SEARCH_CTE,
    sql="SELECT app_id, question_id, rank, id, round_even(cosine * 10000, 0) / 10000 AS score FROM ranked WHERE rank <= 6",
)
def rag_topk_many(t: Tables):
    """Evidence for the first turn of every conversation, from a stored index of each source's documents."""
    chunks = t.documents.select(F.col("source").alias("app_id"), F.col("doc_id").alias("id"), "text")
    index = search_index.build_index(chunks, STOPWORDS)
    source = F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string"))
    asked = t.conversations.filter("turn = 1").select(source.alias("app_id"), F.col("conv_id").alias("question_id"), "text")
    return search_index.search(index, asked)


# --- run ledger ------------------------------------------------------------------
# A user is a run; its first event creates it, except for every tenth user.

LEDGER_CTE = """log AS (SELECT 'run' || user_id AS run_id, event_id AS event_seq, ts AS event_time,
 event_id = min(event_id) OVER (PARTITION BY user_id) AND user_id % 10 <> 9 AS creates, 'App ' || user_id AS app_name,
 CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'needs_review'
 WHEN 'view' THEN '' END AS status, event_type AS step, 'k' || (event_id % 3) AS key,
 json_extract_string(props, '$.k') AS value, CASE WHEN event_type = 'error' THEN 'E' || event_id END AS error FROM events),
 latest AS (SELECT run_id, key, arg_max(value, event_seq) AS value FROM log GROUP BY run_id, key),
 states AS (SELECT run_id, any_value(app_name) AS app_name,
 arg_max(CASE WHEN creates THEN 'running' ELSE status END, event_seq) FILTER ((creates OR status <> '')
 AND (creates OR status IS NOT NULL)) AS status,
 arg_max(step, event_seq) AS current_step, arg_max(coalesce(error, ''), event_seq) AS error,
 min(event_time) AS created_at, arg_max(event_time, event_seq) AS updated_at FROM log GROUP BY run_id HAVING bool_or(creates))"""


def ledger_events(t: Tables):
    first = t.events.groupBy(F.col("user_id").alias("u")).agg(F.min("event_id").alias("first_id"))
    joined = t.events.join(first, F.col("user_id") == F.col("u"))
    creates = (F.col("event_id") == F.col("first_id")) & (F.col("user_id") % 10 != 9)
    status = (
        F.when(creates, "running").when(F.col("event_type") == "error", "failed")
        .when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "signup", "needs_review")
        .when(F.col("event_type") == "view", "")
    )
    value = F.from_json("props", "k string")["k"]
    return joined.select(
        F.concat(F.lit("run"), "user_id").alias("run_id"), F.col("event_id").alias("event_seq"),
        F.col("ts").alias("event_time"), F.when(creates, "create").otherwise("update").alias("kind"),
        F.when(creates, F.concat(F.lit("App "), "user_id")).alias("app_name"), F.lit(None).cast("string").alias("app_id"),
        status.alias("status"), F.col("event_type").alias("step"),
        F.create_map(F.concat(F.lit("k"), F.col("event_id") % 3), value).alias("payload"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("E"), "event_id")).alias("error"),
    )


def states(t: Tables):
    return ledger.state(ledger_events(t))


@query(
    "led_create",
    sql="""SELECT n_name AS app_name, 'running' AS status, 'created' AS step, 32 AS id_length, 0 AS entries FROM nation""",
)
def led_create(t: Tables):
    """One new run per nation; ids are random."""
    requests = t.nation.select(F.col("n_name").alias("app_name"), F.lit(None).cast("string").alias("app_id"))
    return ledger.created(requests).select(
        "app_name", "status", "step", F.char_length("run_id").alias("id_length"), F.size("payload").alias("entries")
    )


@query(
    "led_update", ctes=LEDGER_CTE,
    sql="""SELECT run_id, app_name, status, current_step, error, created_at, updated_at, payload FROM states JOIN
 (SELECT run_id, string_agg(key || '=' || value, ',' ORDER BY key) AS payload FROM latest GROUP BY run_id) USING (run_id)""",
)
def led_update(t: Tables):
    entries = F.transform(F.map_entries("payload"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return states(t).select(
        "run_id", "app_name", "status", "current_step", F.coalesce("error", F.lit("")).alias("error"),
        "created_at", "updated_at", F.array_join(entries, ",").alias("payload"),
    )


@query("led_get", ctes=LEDGER_CTE, sql="SELECT run_id, status, current_step, updated_at FROM states WHERE run_id = 'run8'")
def led_get(t: Tables):
    return ledger.get(states(t), "run8").select("run_id", "status", "current_step", "updated_at")


@query(
    "led_list", ctes=LEDGER_CTE,
    sql="SELECT run_id, created_at, status FROM states ORDER BY created_at DESC, run_id LIMIT 100",
)
def led_list(t: Tables):
    """A limit above 100 is held to 100."""
    return ledger.latest_runs(states(t), 500).select("run_id", "created_at", "status")


@query(
    "led_status", reviews=True, ctes=SPOKEN_CTE,
    sql="""SELECT 'run' || (review_seq // 2) AS run_id, CASE WHEN bool_or(needs_human_review) THEN 'needs_review' ELSE 'completed' END
 AS status FROM analyzed GROUP BY 1""",
)
def led_status(t: Tables):
    run = F.concat(F.lit("run"), F.floor(F.col("review_seq") / 2))
    return ledger.final_status(classify.route(t.reviews()).withColumn("run_id", run))


@query(
    "led_review", ctes=LEDGER_CTE,
    sql="""SELECT d.run_id, approved, d.status IN ('needs_review', 'completed') AND d.status IS NOT NULL AS accepted,
 CASE WHEN d.status IN ('needs_review', 'completed') THEN CASE WHEN approved THEN 'completed' ELSE 'rejected' END
 ELSE d.status END AS status, CASE WHEN d.status IS NULL THEN 'Run not found' WHEN d.status NOT IN ('needs_review', 'completed')
 THEN 'Run is not awaiting review' END AS reason FROM (SELECT c.run_id, approved, s.status FROM
 (SELECT DISTINCT 'run' || user_id AS run_id, user_id % 2 = 0 AS approved FROM events) c LEFT JOIN states s USING (run_id)) d""",
)
def led_review(t: Tables):
    decided = t.events.select(
        F.concat(F.lit("run"), "user_id").alias("run_id"), (F.col("user_id") % 2 == 0).alias("approved")
    ).distinct().withColumn("notes", F.lit(""))
    return ledger.review_outcomes(states(t), decided).drop("notes")


@query("led_gate", reviews=True, sql="SELECT bool_or(prediction_confidence < 0.6) AS requires_human_review FROM reviews")
def led_gate(t: Tables):
    return ledger.review_gate(classify.route(t.reviews()))
