"""Catalogue: classification, duplicates, priority and label overrides."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from voicegrid.config import CALIBRATION_THRESHOLDS, CATEGORY_LABELS
from voicegrid.operators import classify, components, dedupe, overrides, priority, summary
from voicegrid.plans.registry import query
from voicegrid.plans.text_queries import _TOKENS, STATS_CTE, UNI_CTE
from voicegrid.session import materialize, spread
from voicegrid.sources.samples import REVIEW_COLUMNS, Tables

# --- classification --------------------------------------------------------------


@query(
    "ml_label_index", reviews=True,
    sql="""SELECT DISTINCT category, CAST(dense_rank() OVER (ORDER BY category) - 1 AS INTEGER) AS label_index FROM reviews""",
)
def ml_label_index(t: Tables):
    return classify.label_index(t.reviews())


SPLIT_CTE = """counts AS (SELECT category, count(*) AS n FROM reviews GROUP BY category),
 shares AS (SELECT category, test, test * n / whole AS exact, floor(test * n / whole) AS fl FROM counts,
 (SELECT sum(n)::DOUBLE AS whole, ceil(sum(n) * 0.2::DOUBLE - 1e-9) AS test FROM counts)),
 quotas AS (SELECT category, fl + CASE WHEN row_number() OVER (ORDER BY round(exact - fl, 9) DESC, category)
 <= test - sum(fl) OVER () THEN 1 ELSE 0 END AS quota FROM shares)"""


@query(
    "ml_stratified_split", reviews=True, ctes=SPLIT_CTE,
    sql="""SELECT review_seq, r.category, row_number() OVER (PARTITION BY r.category ORDER BY md5('42:' || review_seq), review_seq)
 <= quota AS is_test FROM reviews r JOIN quotas q ON r.category = q.category""",
)
def ml_stratified_split(t: Tables):
    return classify.stratified_split(t.reviews().select("review_seq", "category"))


@query(
    "ml_class_weight", reviews=True,
    sql="""SELECT category, count(*) AS rows, (SELECT count(*) FROM reviews)::DOUBLE
 / ((SELECT count(DISTINCT category) FROM reviews) * count(*)) AS class_weight FROM reviews GROUP BY category""",
)
def ml_class_weight(t: Tables):
    return classify.class_weights(t.reviews())


@lru_cache(maxsize=4)
def trained(spark, folder: str):
    """One trained model per session and folder, shared by the queries below."""
    model, predictions = classify.train(Tables(spark, folder).reviews())
    return model, materialize(predictions, "predictions")


TRAIN_CTE = rf"""{SPLIT_CTE}, split AS (SELECT r.review_seq, r.category, review_text, row_number() OVER (PARTITION BY r.category
 ORDER BY md5('42:' || review_seq), review_seq) <= quota AS is_test FROM reviews r JOIN quotas q ON r.category = q.category),
 learned AS (SELECT review_seq, {_TOKENS} AS tokens FROM split WHERE NOT is_test),
 known AS (SELECT term FROM (SELECT review_seq, unnest(list_distinct(list_concat(tokens,
 [tokens[i] || ' ' || tokens[i + 1] FOR i IN range(1, len(tokens))]))) AS term FROM learned) GROUP BY term HAVING count(*) >= 2)"""


@query(
    "ml_fit", reviews=True, ctes=TRAIN_CTE,
    sql="""SELECT category AS label, count(*) AS support, true AS consistent FROM split WHERE is_test GROUP BY category
 UNION ALL SELECT label, (SELECT count(*) FROM split WHERE is_test), true FROM (VALUES ('accuracy'), ('macro avg'), ('weighted avg')) AS v(label)""",
)
def ml_fit(t: Tables):
    """Held-out report of a freshly trained model: supports, and whether the scores fit each other."""
    report = classify.metrics(trained(t.spark, t.folder)[1])["report"]
    p, r, f1 = F.col("precision"), F.col("recall"), F.col("f1")
    harmonic = F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))
    mean = F.col("label").isin("macro avg", "weighted avg")
    sound = p.between(0, 1) & r.between(0, 1) & f1.between(0, 1) & (mean | (F.abs(f1 - harmonic) < 1e-9))
    return report.select("label", "support", sound.alias("consistent"))


@query(
    "ml_predict", reviews=True,
    sql="SELECT review_seq, true AS known_label, true AS sure_enough, true AS routed FROM reviews",
)
def ml_predict(t: Tables):
    """Every review scored: a known label, a confidence of a best label at least, and the route they lead to."""
    scored = classify.score(t.reviews(), trained(t.spark, t.folder)[0])
    low = F.col("prediction_confidence") < 0.6
    route = F.when(~low, "model_confident").when(F.col("vocabulary_hits") == 0, "translation_or_human").otherwise("llm_ambiguity")
    return scored.select(
        "review_seq", F.col("category").isin(*CATEGORY_LABELS).alias("known_label"),
        F.col("prediction_confidence").between(1 / len(CATEGORY_LABELS) - 1e-9, 1.0).alias("sure_enough"),
        (F.col("review_route") == route).alias("routed"),
    )


@query(
    "ml_dim_check", reviews=True, ctes=TRAIN_CTE,
    sql="SELECT least(count(*), 30000)::INT AS width, true AS agrees FROM known",
)
def ml_dim_check(t: Tables):
    """Text features and classifier of the trained model have the same width: the terms of two training rows or more."""
    model, predictions = trained(t.spark, t.folder)
    classify.check_width(model)
    width = len(classify.vocabulary_of(model))
    return predictions.agg(F.lit(width).alias("width"), (F.count("*") > 0).alias("agrees"))


@query(
    "ml_term_scores", reviews=True, ctes=TRAIN_CTE + """, held AS (SELECT term, category, count(*)::DOUBLE AS o FROM (SELECT s.category,
 unnest(list_distinct(list_concat(tokens, [tokens[i] || ' ' || tokens[i + 1] FOR i IN range(1, len(tokens))]))) AS term
 FROM learned JOIN split s USING (review_seq)) GROUP BY ALL), ns AS (SELECT category, count(*)::DOUBLE AS c FROM split WHERE NOT is_test GROUP BY 1),
 dfs AS (SELECT term, sum(o) AS df FROM held GROUP BY term HAVING sum(o) >= 2), n AS (SELECT sum(c) AS n FROM ns),
 cells AS (SELECT dfs.term, df, coalesce(o, 0) AS o, c, n FROM dfs CROSS JOIN n CROSS JOIN ns
 LEFT JOIN held ON held.term = dfs.term AND held.category = ns.category)""",
    sql="""SELECT term, df::BIGINT AS df, round(sum((o - df * c / n) ** 2 / (df * c / n)
 + CASE WHEN n > df THEN (c - o - (n - df) * c / n) ** 2 / ((n - df) * c / n) ELSE 0 END), 6) AS score FROM cells GROUP BY term, df""",
)
def ml_term_scores(t: Tables):
    """Chi-square of every term of the training rows against the label."""
    from voicegrid.operators import trees

    rows = classify.with_terms(classify.stratified_split(t.reviews()).filter("NOT is_test"))
    return trees.term_scores(rows).withColumn("score", F.round("score", 6))


@query(
    "ml_fit_trees", reviews=True, ctes=TRAIN_CTE,
    sql="SELECT category AS label, count(*) AS support, true AS sound FROM split WHERE is_test GROUP BY category",
)
def ml_fit_trees(t: Tables):
    """Held-out supports of boosted trees, and whether every probability list sums to one and leads to its label."""
    from voicegrid.operators import trees

    _, told = trees.train_trees(t.reviews())
    whole = F.aggregate("probabilities", F.lit(0.0), lambda s, p: s + p)
    sound = (F.abs(whole - 1) < 1e-9) & (F.col("confidence") == F.array_max("probabilities")) & F.col("predicted").isin(*CATEGORY_LABELS)
    return told.groupBy(F.col("actual").alias("label")).agg(F.count("*").alias("support"), F.bool_and(sound).alias("sound"))


def probabilities(t: Tables):
    """Three class probabilities per review; none where the rating is missing."""
    c = F.col("prediction_confidence")
    p = F.when(F.col("rating").isNotNull(), F.array((1 - c) * 0.25, c, (1 - c) * 0.75))
    return t.reviews().select("review_seq", p.alias("p"))


PROB_CTE = """probs AS (SELECT review_seq, CASE WHEN rating IS NOT NULL THEN [(1 - prediction_confidence) * 0.25::DOUBLE,
 prediction_confidence, (1 - prediction_confidence) * 0.75::DOUBLE] END AS p FROM reviews)"""


@query(
    "ml_confidence", reviews=True, ctes=PROB_CTE,
    sql="SELECT review_seq, round(coalesce(list_max(p), 1.0), 9) AS confidence FROM probs",
)
def ml_confidence(t: Tables):
    return probabilities(t).select("review_seq", F.round(classify.confidence(F.col("p")), 9).alias("confidence"))


@query(
    "ml_argmax_label", reviews=True, ctes=PROB_CTE,
    sql="SELECT review_seq, (['Bug', 'Complaint', 'Praise'])[list_position(p, list_max(p))] AS label FROM probs",
)
def ml_argmax_label(t: Tables):
    label = classify.argmax_label(F.col("p"), ("Bug", "Complaint", "Praise"))
    return probabilities(t).select("review_seq", label.alias("label"))


@query(
    "ml_vocab_hits", reviews=True, ctes=f"{UNI_CTE}, {STATS_CTE}, vocab AS (SELECT term FROM stats ORDER BY corpus_tf DESC, term LIMIT 30000)",
    sql="""SELECT review_seq, count(v.term) AS vocabulary_hits FROM reviews LEFT JOIN terms USING (review_seq)
 LEFT JOIN vocab v USING (term) GROUP BY review_seq""",
)
def ml_vocab_hits(t: Tables):
    from voicegrid.operators import features

    rows = t.reviews().select("review_seq", "review_text")
    vocabulary = features.fit_vocabulary(rows, "review_seq", "review_text", max_features=classify.MAX_FEATURES, bigrams=False)
    hits = classify.vocabulary_hits(rows, vocabulary, "review_seq", "review_text", bigrams=False)
    return hits.select("review_seq", "vocabulary_hits")


ROUTE_CTE = """routed AS (SELECT *, prediction_confidence < 0.6 AS needs_human_review,
 CASE WHEN prediction_confidence < 0.6 AND vocabulary_hits = 0 THEN 'translation_or_human'
 WHEN prediction_confidence < 0.6 THEN 'llm_ambiguity' ELSE 'model_confident' END AS review_route,
 prediction_confidence < 0.6 AND vocabulary_hits <> 0 AS requires_llm_review,
 'xgboost' AS classification_source FROM reviews)"""


def route_query(name: str, column: str):
    @query(name, reviews=True, ctes=ROUTE_CTE, sql=f"SELECT review_seq, {column} FROM routed")
    def build(t: Tables):
        return classify.route(t.reviews()).select("review_seq", column)

    return build


route_query("ml_low_conf", "needs_human_review")
route_query("ml_route", "review_route")
route_query("ml_requires_llm", "requires_llm_review")
route_query("ml_source", "classification_source")

_SHIFTED = "(doc_id + CASE WHEN doc_id % 5 = 0 THEN 1 WHEN doc_id % 7 = 0 THEN 2 ELSE 0 END)"
_PREDICTED = REVIEW_COLUMNS["category"].replace("doc_id", _SHIFTED)
PRED_CTE = f"""preds AS (SELECT doc_id AS review_seq, {REVIEW_COLUMNS['category']} AS actual, {_PREDICTED} AS predicted,
 {REVIEW_COLUMNS['prediction_confidence']} AS confidence FROM documents)"""


def predictions(t: Tables):
    return t.documents.selectExpr(
        "doc_id AS review_seq", f"{REVIEW_COLUMNS['category']} AS actual", f"{_PREDICTED} AS predicted",
        f"{REVIEW_COLUMNS['prediction_confidence']} AS confidence",
    )


@query("ml_accuracy", ctes=PRED_CTE, sql="SELECT avg((actual = predicted)::INTEGER::DOUBLE) AS accuracy FROM preds")
def ml_accuracy(t: Tables):
    return classify.accuracy(predictions(t))


@query(
    "ml_class_report", ctes=PRED_CTE + """, per AS (SELECT l.label, coalesce(hits / nullif(called, 0)::DOUBLE, 0) AS precision,
 coalesce(hits / nullif(support, 0)::DOUBLE, 0) AS recall, coalesce(2.0 * hits / nullif(called + support, 0), 0) AS f1, support, hits
 FROM (SELECT label, (SELECT count(*) FROM preds WHERE actual = label) AS support,
 (SELECT count(*) FROM preds WHERE predicted = label) AS called,
 (SELECT count(*) FROM preds WHERE predicted = label AND actual = label) AS hits
 FROM (SELECT DISTINCT unnest([actual, predicted]) AS label FROM preds)) l)""",
    sql="""SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM (
 SELECT label, precision, recall, f1, support FROM per
 UNION ALL SELECT 'accuracy', sum(hits) / sum(support)::DOUBLE, sum(hits) / sum(support)::DOUBLE,
 sum(hits) / sum(support)::DOUBLE, sum(support)::BIGINT FROM per
 UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM per
 UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
 sum(f1 * support) / sum(support), sum(support)::BIGINT FROM per)""",
)
def ml_class_report(t: Tables):
    report = classify.class_report(predictions(t))
    return report.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(
    "ml_confusion", ctes=PRED_CTE,
    sql="SELECT actual, " + ", ".join(f"count(*) FILTER (predicted = '{c}') AS \"{c}\"" for c in CATEGORY_LABELS)
    + " FROM preds GROUP BY actual",
)
def ml_confusion(t: Tables):
    return classify.confusion_matrix(predictions(t), CATEGORY_LABELS)


@query(
    "ml_calibration", ctes=PRED_CTE,
    sql=f"""SELECT threshold, round_even(avg((confidence >= threshold)::INTEGER) * 10000, 0) / 10000 AS coverage,
 round_even(coalesce(avg((actual = predicted)::INTEGER) FILTER (confidence >= threshold), 0) * 10000, 0) / 10000
 AS accuracy_when_retained FROM preds, (SELECT unnest([{', '.join(str(x) for x in CALIBRATION_THRESHOLDS)}]::DOUBLE[]) AS threshold)
 GROUP BY threshold""",
)
def ml_calibration(t: Tables):
    return classify.calibration(predictions(t))


@query(
    "ml_conf_diag", ctes=PRED_CTE,
    sql="""SELECT round_even(min(confidence), 4) AS minimum, round_even(max(confidence), 4) AS maximum,
 round_even(avg(confidence), 4) AS mean FROM preds""",
)
def ml_conf_diag(t: Tables):
    return summary.confidence_diagnostics(predictions(t).withColumnRenamed("confidence", "prediction_confidence"), 4)


@query("ml_class_dist", reviews=True, sql="SELECT category, count(*) AS rows FROM reviews GROUP BY category")
def ml_class_dist(t: Tables):
    return classify.class_distribution(t.reviews())


# --- duplicates ------------------------------------------------------------------
# Languages stand for apps here: one of them holds most of the rows.

DUP_CTE = f"""rows AS (SELECT doc_id AS review_seq, lang AS app_id, tokens,
 CASE WHEN len(tokens) = 0 THEN '#' || doc_id ELSE array_to_string(tokens, ' ') END AS toks FROM
 (SELECT *, {_TOKENS.replace('review_text', 'text')} AS tokens FROM documents)),
 units AS (SELECT app_id, toks, min(review_seq) AS unit, count(*) AS copies, any_value(tokens) AS tokens FROM rows GROUP BY 1, 2)"""
VEC_CTE = f"""{DUP_CTE}, sizes AS (SELECT app_id, count(*)::DOUBLE AS n FROM rows GROUP BY 1),
 terms AS (SELECT app_id, unit, copies, term, count(*) AS tf FROM (SELECT app_id, unit, copies, unnest(list_concat(tokens,
 [tokens[i] || ' ' || tokens[i + 1] FOR i IN range(1, len(tokens))])) AS term FROM units) GROUP BY ALL),
 stats AS (SELECT app_id, term, sum(copies) AS df, count(*) AS users FROM terms GROUP BY 1, 2),
 raw AS (SELECT app_id, unit, term, users, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS w
 FROM terms JOIN stats USING (app_id, term) JOIN sizes USING (app_id)),
 vec AS (SELECT app_id, unit, term, users, w / sqrt(sum(w * w) OVER (PARTITION BY unit)) AS w FROM raw),
 shared AS (SELECT * FROM vec WHERE users > 1)"""
GROUP_CTE = f"""{VEC_CTE}, near AS (SELECT x.unit AS a, y.unit AS b FROM shared x JOIN shared y
 ON x.app_id = y.app_id AND x.term = y.term AND x.unit < y.unit GROUP BY 1, 2 HAVING sum(x.w * y.w) >= 0.9 - 1e-9),
 both_ways AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
 reach AS (SELECT a AS node, a AS root FROM both_ways UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.node),
 comps AS (SELECT node, min(root) AS component FROM reach GROUP BY node),
 placed AS (SELECT u.*, coalesce(component, unit) AS component FROM units u LEFT JOIN comps ON node = unit),
 groups AS (SELECT app_id, component, sum(copies)::BIGINT AS duplicate_count,
 dense_rank() OVER (PARTITION BY app_id ORDER BY component) AS duplicate_group FROM placed GROUP BY app_id, component)"""


def language_reviews(t: Tables):
    return t.documents.selectExpr("doc_id AS review_seq", "lang AS app_id", "text AS review_text")


@lru_cache(maxsize=8)
def duplicate_tables(spark, folder: str):
    """Stored units, vectors and links of a folder, shared by the queries below."""
    units = materialize(dedupe.collapse_copies(language_reviews(Tables(spark, folder))), "units")
    vectors = dedupe.unit_vectors(units)
    return units, vectors, materialize(dedupe.similarity_links(vectors), "links")


@query("dup_exact", ctes=DUP_CTE, sql="SELECT app_id, unit, copies, sha256(toks) AS digest FROM units")
def dup_exact(t: Tables):
    units = dedupe.collapse_copies(language_reviews(t))
    return units.select("app_id", "unit", "copies", dedupe.unit_digest(F.col("tokens")).alias("digest"))


@query(
    "dup_vectors", ctes=VEC_CTE,
    sql="""SELECT unit, count(*) AS shared_terms, round(sum(w), 6) AS weight, round(sum(w * w), 6) AS squared,
 'tfidf_fallback' AS dedupe_method FROM shared GROUP BY unit""",
)
def dup_vectors(t: Tables):
    terms = duplicate_tables(t.spark, t.folder)[1].select("unit", F.inline("vector"))
    return terms.groupBy("unit").agg(
        F.count("*").alias("shared_terms"), F.round(F.sum("w"), 6).alias("weight"),
        F.round(F.sum(F.col("w") * F.col("w")), 6).alias("squared"), F.lit("tfidf_fallback").alias("dedupe_method"),
    )


@query("dup_pairs")
def dup_pairs(t: Tables):
    """Links at or above the threshold that hold the groups together, not all pairs of a group."""
    return duplicate_tables(t.spark, t.folder)[2].withColumn("cosine", F.round("cosine", 6))


@query(
    "dup_pairs_minhash", ctes=GROUP_CTE, recursive=True,
    sql="""SELECT count(*) AS near_units, count(DISTINCT component) AS components, 0::BIGINT AS wrong_links, true AS recall_reached FROM comps""",
)
def dup_pairs_minhash(t: Tables):
    """The approximate links against the exact ones: none is wrong, and 95 of 100 exact links stay inside a group."""
    _, vectors, links = duplicate_tables(t.spark, t.folder)
    found = materialize(dedupe.minhash_links(vectors), "minhash-links")
    exact, near = (components.connected_components(x.select("a", "b")) for x in (links, found))
    ends = near.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    other = near.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    kept = links.select("a", "b").join(ends, "a", "left").join(other, "b", "left").agg(
        (F.count("*") * 0.95 <= F.count_if(F.col("ca") == F.col("cb"))).alias("recall_reached")
    )
    units = exact.agg(F.count("*").alias("near_units"), F.count_distinct("component").alias("components"))
    apart = found.select("a", "b").join(exact.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(
        exact.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left"
    )
    wrong = apart.agg(F.count_if(~F.col("ca").eqNullSafe(F.col("cb")) | F.col("ca").isNull()).alias("wrong_links"))
    return units.select(
        "near_units", "components", wrong.scalar().alias("wrong_links"), kept.scalar().alias("recall_reached"),
    )


@query("dup_components", ctes=GROUP_CTE, recursive=True, sql="SELECT node, component FROM comps")
def dup_components(t: Tables):
    return components.connected_components(duplicate_tables(t.spark, t.folder)[2].select("a", "b"))


def grouped_units(t: Tables):
    units, _, links = duplicate_tables(t.spark, t.folder)
    return dedupe.group_units(units, components.connected_components(links.select("a", "b")))


@query(
    "dup_group_id", ctes=GROUP_CTE, recursive=True,
    sql="SELECT app_id, unit, duplicate_group FROM placed JOIN groups USING (app_id, component)",
)
def dup_group_id(t: Tables):
    return grouped_units(t).select("app_id", "unit", "duplicate_group")


@query(
    "dup_count", ctes=GROUP_CTE, recursive=True,
    sql="""SELECT review_seq, duplicate_group, duplicate_count, 'tfidf_fallback' AS dedupe_method FROM rows
 JOIN placed USING (app_id, toks) JOIN groups USING (app_id, component)""",
)
def dup_count(t: Tables):
    """The whole operator on every review."""
    grouped = dedupe.add_duplicate_groups(language_reviews(t))
    return grouped.select("review_seq", "duplicate_group", "duplicate_count", "dedupe_method")


@query(
    "dup_trivial", reviews=True, ctes="""mixed AS (SELECT review_seq, CASE WHEN review_seq % 10 = 0 THEN 'solo' || review_seq
 ELSE app_id END AS app_id, CASE WHEN app_id = 'src7' THEN ' ' ELSE review_text END AS review_text FROM reviews)""",
    sql="""SELECT app_id, review_seq, row_number() OVER (PARTITION BY app_id ORDER BY review_seq) - 1 AS duplicate_group,
 1::BIGINT AS duplicate_count, 'not_required' AS dedupe_method FROM mixed WHERE app_id IN (SELECT app_id FROM mixed
 GROUP BY app_id HAVING count(*) < 2 OR bool_and(trim(review_text) = ''))""",
)
def dup_trivial(t: Tables):
    """Apps of one review, and one app of blank reviews only."""
    rows = t.reviews().select(
        "review_seq",
        F.when(F.col("review_seq") % 10 == 0, F.concat(F.lit("solo"), "review_seq")).otherwise(F.col("app_id")).alias("app_id"),
        F.when(F.col("app_id") == "src7", " ").otherwise(F.col("review_text")).alias("review_text"),
    )
    return dedupe.trivial_groups(rows).drop("review_text")


# --- priority and feature ranking ------------------------------------------------

PRIORITY_CTE = f"""units AS (SELECT app_id, toks, min(review_seq) AS duplicate_group, count(*) AS duplicate_count FROM
 (SELECT *, CASE WHEN len({_TOKENS}) = 0 THEN '#' || review_seq ELSE array_to_string({_TOKENS}, ' ') END AS toks FROM reviews)
 GROUP BY app_id, toks),
 grouped AS (SELECT r.*, duplicate_group, duplicate_count FROM reviews r JOIN units u ON r.app_id = u.app_id
 AND CASE WHEN len({_TOKENS}) = 0 THEN '#' || review_seq ELSE array_to_string({_TOKENS}, ' ') END = toks),
 weighted AS (SELECT *, CASE category WHEN 'Bug' THEN 4.0 WHEN 'Performance Issue' THEN 3.5 WHEN 'Complaint' THEN 3.0
 WHEN 'UI Issue' THEN 2.5 WHEN 'Feature Request' THEN 2.0 WHEN 'Praise' THEN 0.5 ELSE 1.0 END::DOUBLE AS category_weight FROM grouped),
 ranked AS (SELECT *, round_even((category_weight + (5 - coalesce(rating, 3)) * 0.75::DOUBLE + ln(1.0 + thumbs_up) * 0.5::DOUBLE
 + ln(1.0 + duplicate_count) * 0.75::DOUBLE) * 1000, 0) / 1000 AS priority_score FROM weighted),
 prioritized AS (SELECT *, CASE WHEN priority_score <= 4 THEN 'Low' WHEN priority_score <= 6.5 THEN 'Medium' ELSE 'High' END
 AS priority FROM ranked)"""


def exact_groups(t: Tables):
    """Reviews with their group of exact copies."""
    keyed = dedupe.with_unit(spread(t.reviews())).withColumn("digest", dedupe.unit_digest(F.col("tokens"))).drop("tokens")
    copies = dedupe.collapse_copies(t.reviews()).select(
        "app_id", dedupe.unit_digest(F.col("tokens")).alias("digest"),
        F.col("unit").alias("duplicate_group"), F.col("copies").alias("duplicate_count"),
    )
    stored = materialize(copies, "copies")
    return dedupe.join_frequent(keyed, stored, ["app_id", "digest"], "duplicate_count", stored=True).drop("digest")


def prioritized(t: Tables):
    return priority.add_priority(exact_groups(t))


@query(
    "pri_category_weight", reviews=True, ctes=PRIORITY_CTE,
    sql="SELECT review_seq, category_weight FROM weighted",
)
def pri_category_weight(t: Tables):
    return t.reviews().select("review_seq", priority.category_weight(F.col("category")).alias("category_weight"))


@query("pri_score", reviews=True, ctes=PRIORITY_CTE, sql="SELECT review_seq, priority_score FROM prioritized")
def pri_score(t: Tables):
    return prioritized(t).select("review_seq", "priority_score")


@query("pri_band", reviews=True, ctes=PRIORITY_CTE, sql="SELECT review_seq, priority FROM prioritized")
def pri_band(t: Tables):
    return prioritized(t).select("review_seq", "priority")


FEATURE_CTE = f"""{PRIORITY_CTE}, features AS (SELECT duplicate_group, arg_min(review_text, review_seq) AS request, count(*) AS reach,
 avg(priority_score) AS average_priority, avg(prediction_confidence) AS confidence,
 sum(prediction_confidence) AS evidence_weight FROM prioritized WHERE category = 'Feature Request' GROUP BY duplicate_group),
 riced AS (SELECT *, round_even(evidence_weight * average_priority * confidence * 100, 0) / 100 AS rice_score FROM features),
 best AS (SELECT * FROM riced ORDER BY rice_score DESC, duplicate_group LIMIT 10)"""
_MEANS = ("average_priority", "confidence", "evidence_weight")
_MEANS_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in _MEANS)


def rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in _MEANS})


@query(
    "feat_group", reviews=True, ctes=FEATURE_CTE,
    sql=f"SELECT duplicate_group, md5(request) AS request, reach, {_MEANS_SQL} FROM features",
)
def feat_group(t: Tables):
    return rounded(priority.feature_groups(prioritized(t))).withColumn("request", F.md5("request"))


@query("feat_rice", reviews=True, ctes=FEATURE_CTE, sql="SELECT duplicate_group, rice_score FROM riced")
def feat_rice(t: Tables):
    return priority.with_rice(priority.feature_groups(prioritized(t))).select("duplicate_group", "rice_score")


@query("feat_top_k", reviews=True, ctes=FEATURE_CTE, sql=f"SELECT duplicate_group, request, reach, rice_score, {_MEANS_SQL} FROM best")
def feat_top_k(t: Tables):
    return rounded(priority.build_feature_ranking(prioritized(t)))


@query(
    "feat_rationale", reviews=True, ctes=FEATURE_CTE,
    sql="""SELECT duplicate_group, format('Ranked from {} grouped request(s), average priority {:.2f}, and classification '
 || 'confidence {:.2f}. Validate user reach and effort with analytics and engineering before roadmap commitment.',
 reach, average_priority, confidence) AS rationale FROM best""",
)
def feat_rationale(t: Tables):
    return priority.with_rationale(priority.build_feature_ranking(prioritized(t))).select("duplicate_group", "rationale")


# --- label overrides -------------------------------------------------------------

_LABELS = [*CATEGORY_LABELS, "Other"]
OVR_CTE = f"""{ROUTE_CTE}, selected AS (SELECT * FROM routed WHERE requires_llm_review),
 batched AS (SELECT *, (row_number() OVER (ORDER BY review_seq) - 1) // 100 AS batch FROM selected),
 answers AS (SELECT batch, review_seq + CASE WHEN review_seq % 50 = 1 THEN 1000000 ELSE 0 END AS row,
 ({_LABELS})[review_seq * 5 % 7 + 1] AS category FROM batched),
 accepted AS (SELECT row, category AS new_category FROM answers
 WHERE category <> 'Other' AND row IN (SELECT review_seq FROM batched)),
 applied AS (SELECT review_seq, coalesce(new_category, category) AS category,
 CASE WHEN row IS NULL THEN prediction_confidence ELSE 1.0 END AS prediction_confidence,
 row IS NULL AND needs_human_review AS needs_human_review, row IS NULL AND requires_llm_review AS requires_llm_review,
 CASE WHEN row IS NULL THEN review_route ELSE 'llm_resolved' END AS review_route,
 CASE WHEN row IS NULL THEN classification_source ELSE 'llm_review' END AS classification_source, rating, thumbs_up
 FROM routed LEFT JOIN accepted ON row = review_seq)"""
_OVERRIDE_COLUMNS = (
    "review_seq", "category", "prediction_confidence", "needs_human_review",
    "requires_llm_review", "review_route", "classification_source",
)


def routed(t: Tables):
    return classify.route(t.reviews())


def batched(t: Tables):
    return overrides.numbered_batches(overrides.ambiguous_reviews(routed(t)))


def responses(t: Tables, broken_batch: int | None = None):
    """One fenced JSON answer per batch; some rows and labels are wrong on purpose."""
    row = F.col("review_seq") + F.when(F.col("review_seq") % 50 == 1, 1_000_000).otherwise(0)
    label = F.element_at(F.array(*[F.lit(c) for c in _LABELS]), (F.col("review_seq") * 5 % 7 + 1).cast("int"))
    answers = batched(t).groupBy("batch").agg(
        F.to_json(F.sort_array(F.collect_list(F.struct(row.alias("row"), label.alias("category"))))).alias("answer")
    )
    text = F.concat(F.lit("```json\n"), "answer", F.lit("\n```"))
    if broken_batch is not None:
        text = F.when(F.col("batch") == broken_batch, "no list here").otherwise(text)
    return answers.select("batch", text.alias("response"))


@query("ovr_select", reviews=True, ctes=OVR_CTE, sql="SELECT review_seq FROM selected")
def ovr_select(t: Tables):
    return overrides.ambiguous_reviews(routed(t)).select("review_seq")


@query("ovr_batches", reviews=True, ctes=OVR_CTE, sql="SELECT batch, count(*) AS rows FROM batched GROUP BY batch")
def ovr_batches(t: Tables):
    return overrides.request_batches(overrides.ambiguous_reviews(routed(t))).select("batch", "rows")


@query("ovr_parse", reviews=True, ctes=OVR_CTE, sql="SELECT batch, row, category FROM answers")
def ovr_parse(t: Tables):
    return overrides.decisions(overrides.parse_responses(responses(t))).drop("position")


@query("ovr_validate", reviews=True, ctes=OVR_CTE, sql="SELECT row, new_category FROM accepted")
def ovr_validate(t: Tables):
    parsed = overrides.parse_responses(responses(t))
    return overrides.accepted(overrides.decisions(parsed), batched(t))


@query("ovr_apply", reviews=True, ctes=OVR_CTE, sql=f"SELECT {', '.join(_OVERRIDE_COLUMNS)} FROM applied")
def ovr_apply(t: Tables):
    return overrides.resolve_ambiguous(routed(t), responses(t)).select(*_OVERRIDE_COLUMNS)


@query("ovr_all_or_nothing", reviews=True, ctes=OVR_CTE, sql=f"SELECT {', '.join(_OVERRIDE_COLUMNS)} FROM routed")
def ovr_all_or_nothing(t: Tables):
    """One unreadable answer: nothing changes."""
    return overrides.resolve_ambiguous(routed(t), responses(t, broken_batch=0)).select(*_OVERRIDE_COLUMNS)


@query(
    "pri_rescore", reviews=True, ctes=OVR_CTE,
    sql="""SELECT review_seq, round_even((CASE category WHEN 'Bug' THEN 4.0 WHEN 'Performance Issue' THEN 3.5
 WHEN 'Complaint' THEN 3.0 WHEN 'UI Issue' THEN 2.5 WHEN 'Feature Request' THEN 2.0 WHEN 'Praise' THEN 0.5 ELSE 1.0 END::DOUBLE
 + (5 - coalesce(rating, 3)) * 0.75::DOUBLE + ln(1.0 + thumbs_up) * 0.5::DOUBLE + ln(2.0::DOUBLE) * 0.75::DOUBLE) * 1000, 0) / 1000
 AS priority_score FROM applied""",
)
def pri_rescore(t: Tables):
    """Scores after label decisions, without duplicate counts."""
    resolved = overrides.resolve_ambiguous(routed(t), responses(t))
    return priority.add_priority(resolved).select("review_seq", "priority_score")
