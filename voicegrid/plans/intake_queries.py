"""Catalogue: sources, sinks and app resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from voicegrid.operators import classify, evidence, features, intake, resolve
from voicegrid.plans.registry import query, scratch
from voicegrid.session import spread
from voicegrid.sources import readers, writers
from voicegrid.sources.samples import STOPWORDS, Tables

# --- sources ---------------------------------------------------------------------


@query(
    "src_latest_n", dated=True,
    sql="""SELECT app_id, review_seq, review_date FROM (SELECT *, row_number() OVER (PARTITION BY app_id
 ORDER BY review_date DESC NULLS LAST, review_seq) AS rn FROM dated) WHERE rn <= 10""",
)
def src_latest_n(t: Tables):
    return intake.latest_reviews(t.dated(), 10).select("app_id", "review_seq", "review_date")


def store_records(t: Tables):
    return t.dated().select(
        "app_id", F.upper("app_id").alias("app_name"), F.col("review_text").alias("content"),
        F.col("rating").alias("score"), F.col("thumbs_up").alias("thumbsUpCount"), F.col("review_date").alias("at"),
        F.col("reply_text").alias("replyContent"),
        F.when(F.col("reply_text").isNotNull(), F.col("review_date")).alias("repliedAt"), "review_seq",
    )


@query(
    "src_review_project", dated=True,
    sql="""SELECT app_id, upper(app_id) AS app_name, review_text, rating, thumbs_up, review_date, reply_text,
 CASE WHEN replied THEN review_date END AS reply_date, 'play_store' AS source FROM dated""",
)
def src_review_project(t: Tables):
    return intake.project_reviews(store_records(t))


@query(
    "src_bulk_multi_app", dated=True,
    sql="""SELECT app_id, review_seq, CAST(NULL AS VARCHAR) AS sentiment, CAST(NULL AS VARCHAR) AS category,
 CAST(NULL AS VARCHAR) AS priority, CAST(NULL AS VARCHAR) AS clean_text FROM (SELECT *, row_number() OVER
 (PARTITION BY app_id ORDER BY review_date DESC NULLS LAST, review_seq) AS rn FROM dated) WHERE rn <= 7000""",
)
def src_bulk_multi_app(t: Tables):
    rows = t.dated().select("app_id", "review_seq", "review_date")
    first = F.col("app_id") < "src5"
    return intake.bulk_reviews([rows.filter(first), rows.filter(~first)]).drop("review_date")


@query(
    "src_typed_placeholders", reviews=True,
    sql="""SELECT review_seq, CAST(NULL AS VARCHAR) AS sentiment, CAST(NULL AS VARCHAR) AS category,
 CAST(NULL AS VARCHAR) AS priority, CAST(NULL AS VARCHAR) AS clean_text FROM reviews""",
)
def src_typed_placeholders(t: Tables):
    return intake.with_placeholders(t.reviews().select("review_seq"))


def app_records(t: Tables):
    """Parts in the shape of store app records."""
    return t.part.selectExpr(
        "concat('app', p_partkey) AS app_id", "p_name AS app_name", "p_name AS title",
        "concat(p_type, '\n\n\"', p_brand, '\", and more') AS description", "p_brand AS summary",
        "concat(p_partkey, ',000+') AS installs", "p_size AS ratings", "p_retailprice AS score",
        "p_partkey AS reviews", "p_size % 2 = 0 AS free", "p_type AS genre", "p_brand AS developer",
    )


META_SQL = """SELECT 'app' || p_partkey AS app_id, p_name AS app_name, p_name AS title,
 p_type || chr(10) || chr(10) || '"' || p_brand || '", and more' AS description, p_brand AS summary,
 p_partkey || ',000+' AS installs, CAST(p_size AS BIGINT) AS ratings, p_retailprice AS score,
 p_partkey AS reviews_count, p_size % 2 = 0 AS free, p_type AS genre, p_brand AS developer FROM part"""


@query("src_app_metadata", sql=META_SQL)
def src_app_metadata(t: Tables):
    return intake.app_metadata(app_records(t))


@query(
    "src_app_info", ctes=f"meta AS ({META_SQL})",
    sql="""SELECT r.app_id, title AS "App Name", developer AS "Developer", genre AS "Category", score AS "Rating",
 ratings AS "Total Ratings", installs AS "Downloads", CAST(NULL AS VARCHAR) AS "Released",
 CAST(NULL AS VARCHAR) AS "Last Updated", CAST(NULL AS VARCHAR) AS "Version", CAST(NULL AS VARCHAR) AS "Size",
 description AS "Description", CASE WHEN m.app_id IS NULL THEN 'App not found: ' || r.app_id END AS "Error"
 FROM (SELECT 'app' || (s_suppkey * 25) AS app_id FROM supplier) r LEFT JOIN meta m ON m.app_id = r.app_id""",
)
def src_app_info(t: Tables):
    requests = t.supplier.select(F.concat(F.lit("app"), F.col("s_suppkey") * 25).alias("app_id"))
    return intake.app_information(requests, intake.app_metadata(app_records(t)))


@query("src_csv", sql=META_SQL)
def src_csv(t: Tables):
    """App metadata written as CSV with line breaks and quotes, read back."""
    path = scratch(t, "csv")
    writers._writer(intake.app_metadata(app_records(t)), "csv").save(path)
    return readers.read_metadata(t.spark, path)


@query("src_docs", sql="SELECT page_id, md5(html) AS digest FROM pages")
def src_docs(t: Tables):
    """Pages as one text file each in nested folders, read back whole."""
    path = scratch(t, "docs")
    # A file takes its time whatever its size, so few input files are dealt to all cores; a page stays with one task, as it is one file.
    writers.write_pages(spread(t.pages.select("page_id", F.col("html").alias("value")), "page_id"), path)
    docs = readers.read_documents(t.spark, path)
    return docs.select(
        F.regexp_extract("source", "page_id=([0-9]+)", 1).cast("bigint").alias("page_id"),
        F.md5(F.regexp_replace("text", "\n\\z", "")).alias("digest"),
    )


@query("src_null_guard", reviews=True, sql="SELECT count(*) AS reviews FROM reviews")
def src_null_guard(t: Tables):
    return intake.require_rows(t.reviews()).agg(F.count("*").alias("reviews"))


@query("src_require_columns", reviews=True, sql="SELECT review_seq, category FROM reviews")
def src_require_columns(t: Tables):
    return intake.require_columns(t.reviews(), "review_text", "category").select("review_seq", "category")


# --- sinks -----------------------------------------------------------------------


@query(
    "snk_raw_csv", dated=True,
    sql="""SELECT app_id, '20240201_000000' AS ingest_ts, count(*) AS reviews, sum(length(review_text))::BIGINT AS chars
 FROM dated GROUP BY app_id""",
)
def snk_raw_csv(t: Tables):
    path = scratch(t, "raw")
    raw = intake.project_reviews(store_records(t))
    writers.write_raw(raw, path, ingested=F.lit("2024-02-01").cast("timestamp"))
    back = t.spark.read.schema("review_text string, app_id string, ingest_ts string").parquet(path)
    return back.groupBy("app_id", "ingest_ts").agg(
        F.count("*").alias("reviews"), F.sum(F.char_length("review_text")).alias("chars")
    )


@query(
    "snk_bulk_csv", dated=True,
    sql="""SELECT app_id, 'r' || review_seq AS review_id, CAST(rating AS INTEGER) AS rating,
 CAST(length(review_text) AS INTEGER) AS review_length, CAST(replied AS INTEGER) AS has_reply,
 strftime(review_date, '%Y-%m') AS review_month, md5(review_text) AS digest FROM dated""",
)
def snk_bulk_csv(t: Tables):
    folder = scratch(t, "bulk")
    rows = t.dated().select(
        "app_id", F.col("app_id").alias("app_name"),
        F.concat(F.lit("r"), F.col("review_seq")).alias("review_id"), F.lit(None).cast("string").alias("user_name"),
        "review_text", F.col("rating").cast("int").alias("rating"), "thumbs_up", "review_date", "reply_text",
        F.col("review_date").alias("reply_date"),
    )
    full = intake.with_text_stats(intake.with_placeholders(rows))
    writers.write_bulk(full, intake.app_metadata(app_records(t)), folder)
    back = readers.read_reviews(t.spark, f"{folder}/feedback_data", readers.BULK_REVIEWS)
    return back.select(
        "app_id", "review_id", "rating", "review_length", "has_reply", "review_month", F.md5("review_text").alias("digest")
    )


def routed(t: Tables):
    return classify.route(t.reviews())


@query(
    "snk_run", reviews=True,
    sql="""SELECT 'run' || (review_seq % 3) AS run_id, count(*) AS reviews,
 count(*) FILTER (prediction_confidence < 0.6) AS queued FROM reviews GROUP BY 1""",
)
def snk_run(t: Tables):
    path = scratch(t, "runs")
    writers.write_run(routed(t).withColumn("run_id", F.concat(F.lit("run"), F.col("review_seq") % 3)), path)
    back = t.spark.read.schema("needs_human_review boolean, run_id string").parquet(path)
    return back.groupBy("run_id").agg(F.count("*").alias("reviews"), F.count_if("needs_human_review").alias("queued"))


@query(
    "snk_review_queue", reviews=True,
    sql="""SELECT 'run' || (review_seq % 3) AS run_id, review_seq FROM reviews WHERE prediction_confidence < 0.6""",
)
def snk_review_queue(t: Tables):
    path = scratch(t, "queue")
    writers.write_review_queue(routed(t).withColumn("run_id", F.concat(F.lit("run"), F.col("review_seq") % 3)), path)
    return t.spark.read.schema("review_seq bigint, run_id string").parquet(path)


STOP_SQL = ", ".join(f"'{w}'" for w in STOPWORDS)
CLEAN_SQL = f"""array_to_string(list_filter(regexp_extract_all(regexp_replace(lower(review_text), 'http\\S+', '', 'g'),
 '[a-z]+'), lambda w: w NOT IN ({STOP_SQL})), ' ')"""


@query(
    "snk_clean_csv", dated=True, ctes=f"cleaned AS (SELECT review_seq, replied, {CLEAN_SQL} AS clean_text FROM dated)",
    sql="""SELECT review_seq, md5(clean_text) AS digest, CAST(length(clean_text) AS INTEGER) AS review_length,
 CAST(len(string_split(clean_text, ' ')) AS INTEGER) AS word_count, CAST(replied AS INTEGER) AS has_reply,
 'playstore' AS source FROM cleaned WHERE clean_text <> ''""",
)
def snk_clean_csv(t: Tables):
    path = scratch(t, "clean")
    corpus = intake.clean_corpus(t.dated().select("review_seq", "review_text", "reply_text"), STOPWORDS)
    writers.write_clean_corpus(
        corpus.select("review_seq", "clean_text", "review_length", "word_count", "has_reply", "source"), path
    )
    schema = "review_seq bigint, clean_text string, review_length int, word_count int, has_reply int, source string"
    return readers.read_csv(t.spark, path, schema).withColumn("digest", F.md5("clean_text")).drop("clean_text")


@query(
    "snk_metrics_json", reviews=True,
    sql="""SELECT round_even(min(prediction_confidence), 4) AS minimum, round_even(max(prediction_confidence), 4) AS maximum,
 round_even(avg(prediction_confidence), 4) AS mean FROM reviews""",
)
def snk_metrics_json(t: Tables):
    from voicegrid.operators.summary import confidence_diagnostics

    path = scratch(t, "metrics")
    writers.write_metrics(confidence_diagnostics(t.reviews(), 4), path)
    return t.spark.read.schema("minimum double, maximum double, mean double").json(path)


@query("snk_model", reviews=True, sql="SELECT review_seq, true AS same_label, true AS same_confidence FROM reviews")
def snk_model(t: Tables):
    """Train, save, load: the loaded model scores every review like the saved one."""
    path = scratch(t, "model")
    model, _ = classify.train(t.reviews())
    writers.save_model(model, path)
    columns = ("review_seq", "category", "prediction_confidence")
    before = classify.score(t.reviews(), model).select(*columns)
    after = classify.score(t.reviews(), writers.load_model(path)).select(*columns).toDF("review_seq", "_category", "_confidence")
    return before.join(after, "review_seq").select(
        "review_seq", F.col("category").eqNullSafe(F.col("_category")).alias("same_label"),
        (F.abs(F.col("prediction_confidence") - F.col("_confidence")) < 1e-9).alias("same_confidence"),
    )


@query("snk_features", reviews=True, sql="SELECT review_seq, 1.0::DOUBLE AS squared_length FROM reviews")
def snk_features(t: Tables):
    """TF-IDF rows stored and read back; every row has length one."""
    path = scratch(t, "features")
    rows = t.reviews()
    vocabulary = features.fit_vocabulary(rows, "review_seq", "review_text", bigrams=False)
    writers.write_features(features.tfidf(rows, vocabulary, "review_seq", "review_text", bigrams=False), path)
    back = t.spark.read.schema("review_seq bigint, term string, weight double").parquet(path)
    return back.groupBy("review_seq").agg(F.round(F.sum(F.col("weight") * F.col("weight")), 6).alias("squared_length"))


@query(
    "snk_knowledge_doc",
    sql="""SELECT 'app' || p_partkey AS app_id, 'https://play.google.com/store/apps/details?id=app' || p_partkey AS source,
 '# ' || p_name || chr(10) || chr(10) || 'Source: https://play.google.com/store/apps/details?id=app' || p_partkey
 || chr(10) || 'Retrieved: 2024-02-01' || chr(10) || 'Package ID: app' || p_partkey || chr(10) || 'Developer: ' || p_brand
 || chr(10) || chr(10) || '## Description' || chr(10) || chr(10) || p_type || chr(10) || chr(10)
 || '## Recent changes' || chr(10) || chr(10) || chr(10) AS text FROM part""",
)
def snk_knowledge_doc(t: Tables):
    details = t.part.select(
        F.concat(F.lit("app"), "p_partkey").alias("app_id"), F.col("p_name").alias("title"),
        F.col("p_brand").alias("developer"), F.col("p_type").alias("description"),
        F.lit(None).cast("string").alias("recent_changes"),
    )
    return evidence.competitor_documents(details, F.lit("2024-02-01"))


# --- app resolution --------------------------------------------------------------

_NAME = "concat(p_brand, ' ', p_partkey % 37)"
CANDIDATE_COLUMNS = {
    "search_name": _NAME,
    "search_rank": "p_partkey",
    "candidate_id": "CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE concat('part', p_partkey) END",
    "title": f"CASE WHEN p_partkey % 7 = 0 THEN upper({_NAME}) WHEN p_partkey % 7 = 1 THEN NULL ELSE p_name END",
    "installs": "concat(p_size * p_partkey, ',000+')",
}
CAND_SQL = "cand AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in CANDIDATE_COLUMNS.items()) + """ FROM part),
 valid AS (SELECT * FROM cand WHERE candidate_id IS NOT NULL)"""
_REQUEST = f"CASE c_custkey % 3 WHEN 0 THEN concat('  ', upper(n_name), ' ') WHEN 1 THEN coalesce({_NAME}, c_name) ELSE c_name END"
REQ_SQL = f"""requests AS (SELECT c_custkey AS request_id, {_REQUEST} AS app_name FROM customer
 JOIN nation ON c_nationkey = n_nationkey LEFT JOIN part ON p_partkey = c_custkey)"""
ALIAS_SQL = "aliases AS (SELECT lower(n_name) AS alias, concat('nation', n_nationkey) AS alias_id FROM nation)"


def candidates(t: Tables):
    return t.part.selectExpr(*[f"{v} AS {k}" for k, v in CANDIDATE_COLUMNS.items()])


def requests(t: Tables):
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        t.part, F.col("p_partkey") == F.col("c_custkey"), "left"
    )
    return joined.selectExpr("c_custkey AS request_id", f"{_REQUEST} AS app_name")


def aliases(t: Tables):
    return t.nation.selectExpr("lower(n_name) AS alias", "concat('nation', n_nationkey) AS alias_id")


@query(
    "res_alias", ctes=f"{REQ_SQL}, {ALIAS_SQL}",
    sql="""SELECT request_id, app_name, alias_id AS app_id, app_name AS title, 1.0::DOUBLE AS confidence
 FROM requests JOIN aliases ON trim(lower(app_name)) = alias""",
)
def res_alias(t: Tables):
    return resolve.by_alias(requests(t), aliases(t))


EXACT_SQL = """exact AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY search_name ORDER BY search_rank) AS rn
 FROM valid WHERE lower(title) = lower(search_name)) WHERE rn = 1)"""


@query(
    "res_exact_title", ctes=f"{REQ_SQL}, {CAND_SQL}, {EXACT_SQL}",
    sql="""SELECT request_id, app_name, candidate_id AS app_id, title, 1.0::DOUBLE AS confidence
 FROM requests JOIN exact ON app_name = search_name""",
)
def res_exact_title(t: Tables):
    return resolve.by_exact_title(requests(t), candidates(t))


@query(
    "res_ambiguous", ctes=f"{REQ_SQL}, {CAND_SQL}, {EXACT_SQL}",
    sql="""SELECT request_id, app_name, position, app_id, title FROM requests JOIN (
 SELECT search_name, CAST(row_number() OVER (PARTITION BY search_name ORDER BY search_rank) AS INTEGER) AS position,
 candidate_id AS app_id, coalesce(title, candidate_id) AS title FROM valid
 WHERE search_name NOT IN (SELECT search_name FROM exact)) c ON app_name = search_name WHERE position <= 5""",
)
def res_ambiguous(t: Tables):
    return resolve.ambiguous(requests(t), candidates(t))


@query(
    "res_not_found", ctes=f"{REQ_SQL}, {CAND_SQL}",
    sql="""SELECT request_id, app_name, 'No app found' AS reason FROM requests
 WHERE app_name NOT IN (SELECT search_name FROM valid)""",
)
def res_not_found(t: Tables):
    return resolve.not_found(requests(t), candidates(t))


INSTALLS = "CAST(regexp_replace(installs, '[^0-9]', '', 'g') AS BIGINT)"


@query(
    "res_competitor", ctes=CAND_SQL,
    sql=f"""SELECT search_name AS competitor, candidate_id AS resolved_id, title AS resolved_title,
 CASE WHEN exact THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY search_name
 ORDER BY exact DESC, n DESC, search_rank) AS rn FROM (SELECT *, lower(coalesce(title, '')) = lower(search_name) AS exact,
 {INSTALLS} AS n FROM valid)) WHERE rn = 1""",
)
def res_competitor(t: Tables):
    return resolve.resolve_competitors(candidates(t))


@query("fn_parse_installs", ctes=CAND_SQL, sql=f"SELECT search_rank, {INSTALLS} AS installs FROM cand")
def fn_parse_installs(t: Tables):
    from voicegrid.functions.numeric import parse_installs

    return candidates(t).select("search_rank", parse_installs(F.col("installs")).alias("installs"))


# Competitors of a nation: the other nations of its region, by name.
RIVAL_SQL = """rivals AS (SELECT a.n_name AS app, b.n_name AS competitor, b.n_nationkey AS key,
 CAST(row_number() OVER (PARTITION BY a.n_name ORDER BY b.n_name) - 1 AS INTEGER) AS position
 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey),
 apps AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN s_name ELSE '  ' || lower(n_name) END AS app_name
 FROM supplier JOIN nation ON s_nationkey = n_nationkey),
 expanded AS (SELECT s_suppkey, app_name, position, competitor, key FROM apps
 JOIN rivals ON trim(lower(app_name)) = lower(app)),
 records AS (SELECT s_suppkey, app_name, position, competitor, key, 'offline_seed_dictionary' AS source,
 CASE WHEN key % 3 = 0 THEN 'nation' || key END AS competitor_id, key % 3 = 0 AS verified,
 key % 3 <> 0 AS verification_required, CASE WHEN key % 6 = 0 THEN 'note ' || key END AS resolution_note FROM expanded)"""


def supplier_apps(t: Tables):
    joined = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    name = F.when(F.col("s_suppkey") % 5 == 0, F.col("s_name")).otherwise(F.concat(F.lit("  "), F.lower("n_name")))
    return joined.select("s_suppkey", name.alias("app_name"))


def rival_table(t: Tables):
    other = t.nation.select(F.col("n_regionkey").alias("r"), F.col("n_name").alias("rival"))
    pairs = t.nation.join(other, F.col("n_regionkey") == F.col("r")).filter("rival <> n_name")
    return pairs.groupBy(F.lower("n_name").alias("app_key")).agg(F.sort_array(F.collect_list("rival")).alias("competitors"))


def verified(t: Tables):
    return t.nation.filter("n_nationkey % 3 = 0").selectExpr(
        "lower(n_name) AS name_key", "concat('nation', n_nationkey) AS verified_id",
        "CASE WHEN n_nationkey % 6 = 0 THEN concat('note ', n_nationkey) END AS note",
    )


def records(t: Tables):
    return resolve.competitor_records(resolve.expand_competitors(supplier_apps(t), rival_table(t)), verified(t))


@query("cmp_expand", ctes=RIVAL_SQL, sql="SELECT s_suppkey, app_name, position, competitor FROM expanded")
def cmp_expand(t: Tables):
    return resolve.expand_competitors(supplier_apps(t), rival_table(t))


@query("cmp_records", ctes=RIVAL_SQL, sql="SELECT * EXCLUDE (key) FROM records")
def cmp_records(t: Tables):
    return records(t)


@query(
    "cmp_resolution_note", ctes=RIVAL_SQL,
    sql="""SELECT * EXCLUDE (key) REPLACE (CASE WHEN key % 3 = 1 THEN 'auto' || key ELSE competitor_id END AS competitor_id,
 CASE WHEN key % 3 = 1 THEN 'Resolved automatically to ' || competitor || ' (auto' || key ||
 '); selected by exact title or highest Play Store installs.' ELSE resolution_note END AS resolution_note) FROM records""",
)
def cmp_resolution_note(t: Tables):
    resolved = t.nation.filter("n_nationkey % 3 = 1").selectExpr(
        "n_name AS competitor", "concat('auto', n_nationkey) AS resolved_id", "n_name AS resolved_title"
    )
    return resolve.with_resolution(records(t), resolved)


MATCH_SQL = """matches AS (SELECT n_name, count(*) AS n, min('s' || s_suppkey) AS only_id FROM supplier
 JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 = 0 GROUP BY n_name),
 unique_checked AS (SELECT r.* EXCLUDE (key), coalesce(competitor_id, CASE WHEN n = 1 THEN only_id END) AS matched_id,
 CASE WHEN competitor_id IS NULL AND coalesce(n, 0) <> 1
 THEN 'Expected one exact match; found ' || coalesce(n, 0) END AS reason FROM records r
 LEFT JOIN matches ON competitor = n_name)"""


def supplier_candidates(t: Tables):
    """Search results per nation; a third of them carry its exact name."""
    joined = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.selectExpr(
        "n_name AS search_name", "concat('s', s_suppkey) AS candidate_id",
        "CASE WHEN s_suppkey % 3 = 0 THEN lower(n_name) ELSE s_name END AS title",
    )


@query("cmp_verify_unique", ctes=f"{RIVAL_SQL}, {MATCH_SQL}", sql="SELECT * FROM unique_checked")
def cmp_verify_unique(t: Tables):
    return resolve.verify_unique(records(t), supplier_candidates(t))


@query(
    "cmp_verify_title_prefix", ctes=f"""{RIVAL_SQL}, {MATCH_SQL}, details AS (SELECT 'nation' || n_nationkey AS app_id,
 CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) || ' app' ELSE 'other ' || n_name END AS title FROM nation)""",
    sql="""SELECT u.* EXCLUDE (verified, reason), title AS package_title,
 coalesce(reason, CASE WHEN NOT starts_with(lower(coalesce(title, '')), lower(competitor))
 THEN 'Package title mismatch: ' || coalesce(title, 'null') END) AS reason,
 reason IS NULL AND starts_with(lower(coalesce(title, '')), lower(competitor)) AS verified
 FROM unique_checked u LEFT JOIN details ON matched_id = app_id""",
)
def cmp_verify_title_prefix(t: Tables):
    details = t.nation.selectExpr(
        "concat('nation', n_nationkey) AS app_id",
        "CASE WHEN n_nationkey % 2 = 0 THEN concat(lower(n_name), ' app') ELSE concat('other ', n_name) END AS title",
    )
    return resolve.verify_title(resolve.verify_unique(records(t), supplier_candidates(t)), details)


@query(
    "cmp_top_k", ctes=RIVAL_SQL,
    sql="SELECT s_suppkey, app_name, position, competitor FROM expanded WHERE position < 3",
)
def cmp_top_k(t: Tables):
    return resolve.expand_competitors(supplier_apps(t), rival_table(t), limit=3)


@query(
    "cmp_skipped", reviews=True,
    sql="""SELECT n_name AS competitor, 'src' || n_nationkey AS competitor_id, 'No reviews returned' AS reason FROM nation
 WHERE 'src' || n_nationkey NOT IN (SELECT app_id FROM reviews)""",
)
def cmp_skipped(t: Tables):
    listed = t.nation.selectExpr("n_name AS competitor", "concat('src', n_nationkey) AS competitor_id")
    return resolve.skipped_competitors(listed, t.reviews())


@query(
    "cmp_matched_sample", dated=True,
    sql="""SELECT app_id, review_seq FROM (SELECT *, row_number() OVER (PARTITION BY app_id
 ORDER BY review_date DESC NULLS LAST, review_seq) AS rn FROM dated
 WHERE app_id IN (SELECT 'src' || n_nationkey FROM nation WHERE n_regionkey = 1)) WHERE rn <= 25""",
)
def cmp_matched_sample(t: Tables):
    apps = t.nation.filter("n_regionkey = 1").selectExpr("concat('src', n_nationkey) AS app_id")
    return resolve.matched_samples(t.dated(), apps, 25).select("app_id", "review_seq")


@query(
    "cmp_first_app_id",
    sql="SELECT lang AS app_name, arg_min(source, doc_id) AS app_id FROM documents GROUP BY lang",
)
def cmp_first_app_id(t: Tables):
    rows = t.documents.selectExpr("lang AS app_name", "source AS app_id", "doc_id AS review_seq")
    return resolve.first_app_id(rows)


@query(
    "join_meta", reviews=True,
    sql="""SELECT app_id AS app_name, r.review_seq, n_name AS title, n_regionkey AS region FROM reviews r
 LEFT JOIN nation ON app_id = 'src' || (n_nationkey * 2)""",
)
def join_meta(t: Tables):
    meta = t.nation.selectExpr("concat('src', n_nationkey * 2) AS app_name", "n_name AS title", "n_regionkey AS region")
    rows = t.reviews().select(F.col("app_id").alias("app_name"), "review_seq")
    return resolve.attach_metadata(rows, meta)
