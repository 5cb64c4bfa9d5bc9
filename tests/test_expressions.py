import math

import pytest
from pyspark.sql import functions as F

from voicegrid.functions import numeric, text, vectors
from voicegrid.operators import features


def values(spark, kind, rows, expression):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_normalize_strips_every_white_space(spark):
    rows = ["  GREAT App ", "\t\nÉtÉ ", None, " a\x1f"]
    assert values(spark, "string", rows, text.normalize) == ["great app", "été", "", "a"]


def test_clean_text(spark):
    rows = ["See HTTPS://x.io/a?b=1 NOW!! it's the  Best, 5 stars", "123 !!", None]
    got = values(spark, "string", rows, lambda c: text.clean_text(c, ("the", "it")))
    assert got == ["see now s best stars", "", None]


def test_counts_and_flags(spark):
    rows = ["a  bb\tccc", "", None, "👌👌", "ok fine"]
    assert values(spark, "string", rows, text.word_count) == [3, 0, None, 1, 2]
    assert values(spark, "string", rows, text.has_letter) == [True, False, False, False, True]
    assert values(spark, "string", rows, text.is_interpretable) == [True, False, False, False, True]
    assert values(spark, "string", rows, text.is_blank) == [False, True, True, False, False]


def test_vector_tokens_and_ngrams(spark):
    rows = ["The CAFÉ x no_1", "a", "日本語 テスト"]
    assert values(spark, "string", rows, text.vector_tokens) == [["the", "café", "no_1"], [], ["日本語", "テスト"]]
    got = values(spark, "string", rows[:2], lambda c: text.ngrams(text.vector_tokens(c)))
    assert got == [["the", "café", "no_1", "the café", "café no_1"], []]


def test_term_counts_matches_plain_counting(spark):
    rows = [["b", "a", "b", "c", "a", "b"], [], ["x"]]
    got = values(spark, "array<string>", rows, text.term_counts)
    assert [{r["term"]: r["tf"] for r in g} for g in got] == [{"a": 2, "b": 3, "c": 1}, {}, {"x": 1}]


def test_to_number_and_clip(spark):
    rows = ["4", " 2.5 ", "bad", None, "NaN", "9"]
    assert values(spark, "string", rows, numeric.to_number) == [4.0, 2.5, None, None, None, 9.0]
    assert values(spark, "string", rows, lambda c: numeric.clip(numeric.to_number(c), 1, 5)) == [4.0, 2.5, None, None, None, 5.0]


def test_rounding_is_half_even(spark):
    assert values(spark, "double", [0.0625, 0.1875, 2.5], lambda c: numeric.round_even(c, 3)) == [0.062, 0.188, 2.5]
    assert values(spark, "double", [0.5, 1 / 3], numeric.rate) == [50.0, 33.3]


def test_band_and_bin_edges(spark):
    assert values(spark, "double", [4.0, 4.001, 6.5, 6.501, None], numeric.priority_band) == ["Low", "Medium", "Medium", "High", None]
    got = values(spark, "double", [0.0, 0.5, 0.51, 0.6, 1.0, 1.1, -0.1], numeric.confidence_bin)
    assert got == ["0.00-0.49", "0.00-0.49", "0.50-0.59", "0.50-0.59", "0.90-1.00", None, None]


def test_parse_installs(spark):
    assert values(spark, "string", ["500,000,000+", "", None, "none"], numeric.parse_installs) == [500000000, 0, 0, 0]


def test_sparse_dot(spark):
    kind = "struct<l: array<struct<k1: bigint, k2: bigint, w: double>>, r: array<struct<k1: bigint, k2: bigint, w: double>>>"
    rows = [([(1, 1, 0.5), (2, 2, 2.0)], [(2, 2, 3.0), (3, 3, 1.0), (1, 9, 7.0)]), ([], [(1, 1, 1.0)])]
    got = values(spark, kind, rows, lambda c: vectors.sparse_dot(c["l"], c["r"]))
    assert got == [6.0, 0.0]


def test_hash_embedding_is_unit_length_and_whole(spark):
    rows = ["dark mode please", "dark mode please", "", "word " * 3000]
    got = values(spark, "string", rows, features.hash_embedding)
    assert got[0] == got[1] and all(len(v) == 384 for v in got)
    assert [round(math.sqrt(sum(x * x for x in v)), 9) for v in got] == [1.0, 1.0, 0.0, 1.0]


def test_strip_accents(spark):
    assert values(spark, "string", ["Ça été naïf, Ñandú"], text.strip_accents) == ["Ca ete naif, Nandu"]


def test_tfidf_against_hand_computation(spark):
    docs = spark.createDataFrame([(1, "red red blue"), (2, "blue green"), (3, "blue")], "id long, body string")
    vocabulary = features.fit_vocabulary(docs, "id", "body", bigrams=False)
    rows = features.tfidf(docs, vocabulary, "id", "body", bigrams=False).collect()
    got = {(r["id"], r["term"]): r["weight"] for r in rows}
    idf = {t: math.log(4 / (1 + n)) + 1 for t, n in (("red", 1), ("blue", 3), ("green", 1))}
    red, blue = 2 * idf["red"], idf["blue"]
    assert got[(1, "red")] == pytest.approx(red / math.hypot(red, blue))
    assert got[(3, "blue")] == pytest.approx(1.0)
    assert set(vocabulary.filter("df >= 2").toPandas()["term"]) == {"blue"}
