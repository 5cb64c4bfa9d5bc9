"""Steps that count terms: what they compute, and how often text and terms are moved."""

from pyspark.sql import functions as F

from voicegrid.operators import classify, features, trees

ROWS = [(1, "red blue red blue", "a"), (2, "blue green", "b"), (3, "", "a"), (4, None, "b"), (5, "green green red", None)]


def docs(spark):
    return spark.createDataFrame(ROWS, "id long, body string, category string")


def test_terms_are_counted_without_counting_inside_rows(spark):
    stats = features.term_stats(features.term_table(docs(spark), "id", "body")).collect()
    assert {(r["term"], r["df"]) for r in stats} == {tuple(r) for r in features.document_frequencies(docs(spark), "body").collect()}
    assert {(r["term"], r["corpus_tf"]) for r in stats} == {tuple(r) for r in features.occurrences(docs(spark), "body").collect()}


def test_a_stored_term_table_is_not_made_again(spark):
    terms = features.term_table(docs(spark), "id", "body", bigrams=False)
    vocabulary = features.fit_vocabulary(docs(spark), "id", "body", terms=terms)
    again = features.fit_vocabulary(docs(spark), "id", "body", bigrams=False)
    assert sorted(vocabulary.collect()) == sorted(again.collect())
    # Nothing but the given table is read.
    found = features.tfidf(docs(spark).select("id", F.lit("other words").alias("body")), vocabulary, "id", "body", terms=terms)
    assert {r["term"] for r in found.collect()} == {"red", "blue", "green"}


def test_frequent_terms_break_ties_by_term(spark):
    rows = classify.with_terms(docs(spark), "body")
    assert classify.frequent_terms(rows, 3) == ["blue", "green", "red"]
    assert classify.frequent_terms(rows, 10, 1)[:4] == ["blue", "green", "red", "red blue"]


def test_terms_are_scored_in_one_shuffle(spark):
    found = trees.term_scores(classify.with_terms(docs(spark), "body"), min_df=1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(term") == 1
    # Rows without a label count in no term.
    assert {r["term"]: r["df"] for r in found.collect()}["green"] == 1
