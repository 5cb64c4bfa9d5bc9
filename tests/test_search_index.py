import math
import random
import re
from collections import Counter

import pytest

from voicegrid.operators import evidence, search_index

STOP = ("the", "of")


def corpus(seed=2, count=400):
    rnd = random.Random(seed)
    words = [f"w{n}" for n in range(300)]
    weights = [1 / (n + 1) for n in range(300)]
    rows = []
    for n in range(count):
        size = rnd.choice([0, 1, 4, 30, 120])
        rows.append((f"app{n % 3 if n % 2 else 0}", n, " ".join(rnd.choices(words, weights, k=size)) + rnd.choice([" the", " of a", ""])))
    rows += [("app0", 1000 + n, rows[3][2]) for n in range(30)] + [(None, 5000, "w1 w2"), ("app1", 5001, None)]
    asked = [(f"app{n % 4}", n, " ".join(rnd.choices(words, k=rnd.choice([1, 2, 5, 20])))) for n in range(1000)]
    asked += [("app0", 2000, "unknown words only"), ("app0", 2001, ""), ("app0", 2002, None), ("nowhere", 2003, "w1")]
    return rows, asked


def tokens(value):
    return Counter(t for t in re.findall(r"\w{2,}", (value or "").lower()) if t not in STOP)


def by_hand(rows, asked, limit):
    out = {}
    bags = {}
    for app, key, value in rows:
        if app is not None:
            bags.setdefault(app, {})[key] = tokens(value)
    dfs = {app: Counter(t for bag in docs.values() for t in bag) for app, docs in bags.items()}
    for app, question, value in asked:
        q, docs, df = tokens(value), bags.get(app, {}), dfs.get(app, {})
        n = len(docs) + 1
        idf = lambda t: math.log((1 + n) / (1 + df.get(t, 0) + (t in q))) + 1  # noqa: B023, E731
        length = math.sqrt(sum((c * idf(t)) ** 2 for t, c in q.items()))
        scored = []
        for key, bag in docs.items():
            dot = sum(c * idf(t) * q[t] * idf(t) for t, c in bag.items() if t in q)
            if dot > 0:
                scored.append((-round(dot / length / math.sqrt(sum((c * idf(t)) ** 2 for t, c in bag.items())), 12), key))
        out[app, question] = [(key, -score) for score, key in sorted(scored)[:limit]]
    return {k: v for k, v in out.items() if v}


@pytest.mark.parametrize("limit, champions", [(6, 16), (1, 1), (40, 3)])
def test_a_thousand_questions_equal_scoring_everything(spark, limit, champions):
    rows, asked = corpus()
    index = search_index.build_index(spark.createDataFrame(rows, "app_id string, id long, text string"), STOP, champions=champions)
    found = search_index.search(index, spark.createDataFrame(asked, "app_id string, question_id long, text string"), limit).collect()
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault((r["app_id"], r["question_id"]), []).append((r["id"], r["score"]))
    want = by_hand(rows, asked, limit)
    assert set(got) == set(want)
    for k, answers in want.items():
        assert [i for i, _ in got[k]] == [i for i, _ in answers]
        assert all(abs(a - b) < 6e-5 for (_, a), (_, b) in zip(got[k], answers))


def test_same_as_one_question_at_a_time(spark):
    rows, _ = corpus(5, 120)
    chunks = spark.createDataFrame([r for r in rows if r[0] == "app0"], "app_id string, id long, text string")
    index = search_index.build_index(chunks, STOP)
    for question in ("w0 w5 w20", "w1 the w299"):
        asked = spark.createDataFrame([("app0", 1, question)], "app_id string, question_id long, text string")
        many = {(r["id"], r["score"]) for r in search_index.search(index, asked).collect()}
        assert many == {(r["id"], r["score"]) for r in evidence.top_k_tfidf(chunks, question, stopwords=STOP).collect()}


def test_bounds_leave_postings_unread(spark):
    rows = [("a", n, "common " + " ".join(f"x{n}y{k}" for k in range(30))) for n in range(200)] + [("a", 500, "rare rare common")]
    index = search_index.build_index(spark.createDataFrame(rows, "app_id string, id long, text string"))
    asked = search_index.question_terms(index, spark.createDataFrame([("a", 1, "rare common")], "app_id string, question_id long, text string"))
    assert [r["id"] for r in search_index.candidates(index, asked, 1).collect()] == [500]
    # The second best needs the frequent term.
    assert search_index.candidates(index, asked, 2).count() == 201


def test_nothing_to_search(spark):
    index = search_index.build_index(spark.createDataFrame([], "app_id string, id long, text string"))
    asked = spark.createDataFrame([("a", 1, "word")], "app_id string, question_id long, text string")
    assert search_index.search(index, asked).count() == 0


def test_scores_meet_documents_in_blocks(spark, monkeypatch):
    """A document stands once in each slice of questions; it isn't joined to every candidate."""
    monkeypatch.setattr(search_index, "BLOCK_DOCUMENTS", 16)
    monkeypatch.setattr(search_index, "SLICE_QUESTIONS", 8)
    rows, asked = corpus(7, 150)
    index = search_index.build_index(spark.createDataFrame(rows, "app_id string, id long, text string"), STOP)
    found = search_index.search(index, spark.createDataFrame(asked[:60], "app_id string, question_id long, text string"), 4).collect()
    want = by_hand(rows, asked[:60], 4)
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault((r["app_id"], r["question_id"]), []).append(r["id"])
    assert got == {k: [i for i, _ in v] for k, v in want.items()}


def test_rows_of_one_question_are_asked_together(spark):
    chunks = spark.createDataFrame([("a", 1, "red blue"), ("a", 2, "blue green green"), ("a", 3, "grey")], "app_id string, id long, text string")
    index = search_index.build_index(chunks)

    def asked(*rows):
        questions = spark.createDataFrame(rows, "app_id string, question_id long, text string")
        return sorted((r["rank"], r["id"], r["score"]) for r in search_index.search(index, questions).collect())

    assert asked(("a", 1, "red blue"), ("a", 1, "blue green")) == asked(("a", 1, "red blue blue green"))


def test_many_questions_make_no_list_of_candidates(spark, monkeypatch):
    """Their candidates would be more rows than the index has postings; blocks report their best documents only."""
    monkeypatch.setattr(search_index, "BLOCK_DOCUMENTS", 50)
    rows, asked = corpus(9, 200)
    index = search_index.build_index(spark.createDataFrame(rows, "app_id string, id long, text string"), STOP)
    # A row of the index is a block: words stand in it once.
    assert index.documents.count() < 16
    monkeypatch.setattr(search_index, "candidates", None)
    found = search_index.search(index, spark.createDataFrame(asked, "app_id string, question_id long, text string"), 3).collect()
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault((r["app_id"], r["question_id"]), []).append(r["id"])
    assert got == {k: [i for i, _ in v] for k, v in by_hand(rows, asked, 3).items()}
