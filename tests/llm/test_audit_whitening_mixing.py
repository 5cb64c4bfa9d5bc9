import itertools
import math
import random
import re
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voicegrid.llm import filter_audit, mixing, whitening
from voicegrid.llm.common import prepare

SCHEMA = "doc_id bigint, text string, source string, mask int, digest string, size int, key string, copies int, words string"
LABELS = "doc_id bigint, quality int, toxic int, good int"


def some_documents(seed=3, count=160):
    rnd = random.Random(seed)
    pool = ["alpha", "Beta", "GAMMA", "delta", "eps$ilon", "zeta|", "\x0beta", "été", " ", "日本"]
    texts = [" ".join(rnd.choice(pool) + str(rnd.randrange(60)) for _ in range(rnd.choice([3, 49, 50, 51, 80]))) for _ in range(60)]
    texts += ["", None, " \t\n", "word " * 9000, "A" * 30_000]
    rows = [(n, rnd.choice(texts), rnd.choice(["b", "a", "", None, "Z", "é"])) for n in range(count)]
    rows += rows[:3] + [(None, texts[0], "a"), (None, texts[0], "a"), (7, "another text of the same id", None)]
    return [(i, t, s, 1, "d", 2, "k", 3, "w") for i, t, s in rows]


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    return spark.createDataFrame(some_documents(), SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---- filter interaction audit


def audit_by_hand(rows, labels):
    good = {i for i, q, _, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t, _ in labels if t == 1 and i is not None}
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    failed = []
    for i, t, s, *_ in rows:
        t, w = t or "", words_of(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        failed.append((s or "", i, {x for x, f in fails.items() if f}))
    out, total = {}, {}
    for part in {p for p, _, _ in failed}:
        for order in itertools.permutations("ABCDE"):
            left = [(i, f) for p, i, f in failed if p == part]
            gone = []
            for step, letter in enumerate(order, 1):
                removed = [(i, f) for i, f in left if letter in f]
                redundant = sum(letter in f for _, f in gone)
                gone += removed
                left = [(i, f) for i, f in left if letter not in f]
                unique = sum(f == {letter} for p, _, f in failed if p == part)
                out[part, "".join(order), step] = (
                    len(left), len(removed), redundant, unique, sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed),
                )
                total[part, letter] = total.get((part, letter), 0) + len(removed)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


LABEL_ROWS = [(n, n % 2, n % 3 == 0, 5) for n in range(0, 120)] + [(4, 1, 1, 5), (5, None, None, 5), (None, 1, 1, 5), (9999, 1, 1, 5)]


def test_audit_equals_applying_the_filters_in_every_order(spark, docs):
    labels = [(i, q, None if t is None else int(t), g) for i, q, t, g in LABEL_ROWS]
    found = filter_audit.audit(docs, spark.createDataFrame(labels, LABELS)).collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[m] for m in (*filter_audit.METRICS, "shapley")) for r in found}
    assert len(got) == len(found) and got == audit_by_hand(some_documents(), labels)


def test_audit_of_nothing_and_without_labels(spark, docs):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(docs.limit(0), none).count() == 0
    found = filter_audit.audit(docs, none)
    assert found.agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0) and found.count() == 5 * 120 * 5


def test_audit_walk_has_every_prefix_once(spark):
    walk = filter_audit.steps(spark, spark.range(32).selectExpr("int(id) AS mask"), list("ABCDE")).toPandas()
    assert len(walk) == 32 * 325 and not walk.duplicated(["prefix", "mask"]).any()
    assert (walk["prefix"].str.len() == walk["step"]).all() and (walk["prefix"].str[-1] == walk["letter"]).all()
    assert all(len(set(p)) == len(p) for p in walk["prefix"])


def test_audit_takes_other_filters(spark, docs):
    shorter = filter_audit.audit(
        docs, spark.createDataFrame([], LABELS), lambda text, words: {"S": F.size(words) < 5, "L": F.length(text) > 400}, copies="C"
    )
    assert {r[0] for r in shorter.select("filter_order").distinct().collect()} == set(map("".join, itertools.permutations("SLC")))


# ---- whitening


def vectors_at_random(seed=1, count=300, width=7):
    rnd = np.random.default_rng(seed)
    mixed = rnd.normal(size=(count, width)) @ rnd.normal(size=(width, width)) + rnd.normal(size=width) * 3
    rows = [(n, v.tolist(), 1) for n, v in enumerate(mixed)]
    rows += [(n + 1000, rows[0][1], 1) for n in range(200)] + [(None, rows[1][1], 1), (3, rows[3][1], 1), (3, rows[3][1], 1)]
    bad = [(-1, None, 1), (-2, [None] + [1.0] * (width - 1), 1), (-3, [math.inf] + [1.0] * (width - 1), 1),
           (-4, [math.nan] * width, 1), (-5, [], 1), (-6, [1.0], 1)]
    return rows, bad


VECTORS = "vec_id bigint, embedding array<double>, x int"


def test_whitening_equals_an_eigendecomposition(spark):
    prepare(spark)
    rows, bad = vectors_at_random()
    found = whitening.whitened_rows(spark.createDataFrame(rows + bad, VECTORS)).toPandas()
    grid = np.floor(256 * np.array([v for _, v, _ in rows])).astype(np.int64)
    fit = np.unique(grid, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    covariance = np.cov(fit.T.astype(float), bias=True)
    values, directions = np.linalg.eigh(covariance)
    values, directions = values[::-1], directions[:, ::-1]
    assert len(found) == 4 * len(rows) and set(found["n"]) == {n}
    assert found["identity_error"].nunique() == 1 and 0 <= found["identity_error"].iloc[0] < 1e-10
    assert found["whitened"].abs().max() < 100
    for component, part in found.groupby("component"):
        e, u = values[component - 1], directions[:, component - 1]
        assert np.allclose(part["explained"], e / np.trace(covariance), rtol=1e-9)
        want = sorted((str(i), float(abs(p))) for (i, _, _), p in zip(rows, (grid - sums / n) @ u / math.sqrt(e)))
        got = sorted((str(None if pd.isna(i) else int(i)), abs(w)) for i, w in zip(part["vec_id"], part["whitened"]))
        assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([w for _, w in got], [w for _, w in want], atol=1e-8)
    deviations = dict(zip(found["vec_id"].fillna(-9).astype(int), found["deviation"]))
    for (i, _, _), x in zip(rows, grid.tolist()):
        assert deviations[-9 if i is None else i] == sum((n * a - s) ** 2 for a, s in zip(x, sums.tolist()))


def test_one_sign_of_a_component_for_all_rows(spark):
    rows, _ = vectors_at_random(2, 80, 5)
    found = whitening.whitened_rows(spark.createDataFrame(rows, VECTORS).repartition(7)).toPandas().dropna()
    wide = found.drop_duplicates(["vec_id", "component"]).pivot(index="vec_id", columns="component", values="whitened")
    fit = wide[wide.index < 80]
    assert np.allclose(fit.T @ fit / 80, np.eye(4), atol=1e-9)


@pytest.mark.parametrize("vectors, components", [
    ([], 0), ([[1.0, 2.0]] * 5, 0), ([[1.0, 2.0], [3.0, 4.0]], 1), ([[1.0], [2.0], [4.0]], 1),
    ([[1e300, -1e300], [1.0, 1e-300], [0.0, 5.0]], 1), ([None, [None]], 0),
])
def test_whitening_of_few_directions(spark, vectors, components):
    frame = spark.createDataFrame([(n, v, 0) for n, v in enumerate(vectors)], VECTORS)
    found = whitening.whitened_rows(frame).toPandas()
    assert len(found) == components * sum(v is not None and None not in v for v in vectors)
    if components:
        assert found["identity_error"].max() < 1e-9 and abs(found.drop_duplicates("component")["explained"].sum() - 1) < 1e-9


@pytest.mark.parametrize("tasks", [1, 16, 17, 300])
def test_matrices_of_many_tasks_are_added_in_levels(spark, tasks):
    rows = spark.range(900).selectExpr("array(id, id % 7, id * id % 11) AS x").repartition(tasks)
    points = np.array([r["x"] for r in rows.collect()], dtype=float)
    got = whitening.scatter(rows, 3, lambda part: whitening._matrix(part.column(0), 3, np.float64))
    assert np.array_equal(got, points.T @ points)
    assert np.array_equal(whitening.scatter(rows.limit(0), 3, lambda part: whitening._matrix(part.column(0), 3, np.float64)), np.zeros((3, 3)))


@pytest.mark.parametrize("width, rank", [(1, 1), (2, 1), (9, 9), (24, 24), (40, 11)])
def test_factorisation(width, rank):
    rnd = np.random.default_rng(width)
    points = rnd.normal(size=(rank, width)) * np.logspace(0, -5, rank)[:, None]
    matrix = points.T @ points
    order, lower = whitening.pivoted_cholesky(matrix)
    assert np.allclose(lower @ lower.T, matrix[np.ix_(order, order)], atol=1e-12 * np.trace(matrix))
    values, directions = whitening.components(matrix)
    assert np.allclose(directions @ directions.T, np.eye(len(values)), atol=1e-10)
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:len(values)], atol=1e-12 * np.trace(matrix))


def test_small_eigenvalues_keep_their_precision():
    scales = 10.0 ** -np.arange(8)
    matrix = scales[:, None] * (np.eye(8) + 0.1) * scales[None, :]
    # The determinant by exact fractions.
    exact = Fraction(1)
    rows = [[Fraction(float(v)) for v in r] for r in matrix]
    for k in range(8):
        exact *= rows[k][k]
        for r in range(k + 1, 8):
            f = rows[r][k] / rows[k][k]
            rows[r] = [a - f * b for a, b in zip(rows[r], rows[k])]
    values, _ = whitening.components(matrix)
    assert abs(math.prod(Fraction(float(v)) for v in values) / exact - 1) < 1e-9


@pytest.mark.parametrize("n, high", [(5, 300), (10**6, 300), (10**9, 300), (10**9, 10**12), (3, 10**18)])
def test_deviations_are_exact(n, high):
    rnd = np.random.default_rng(0)
    x = rnd.integers(-high, high, size=(50, 64))
    sums = tuple(int(v) for v in rnd.integers(-high, high, size=64) * 3)
    assert whitening.exact_deviations(x, n, sums) == [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x.tolist()]


# ---- mixing


def levels_by_hand(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[n % 3] for n, s in enumerate(names)}
    left, stopped = Fraction(3 * sum(sizes.values()), 2), {}
    while True:
        open_ = [s for s in names if s not in stopped]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return stopped | share
        for s in over:
            stopped[s] = Fraction(2 * sizes[s])
        left = Fraction(3 * sum(sizes.values()), 2) - sum(stopped.values())


def test_mix_meets_its_targets(spark, docs):
    rows = some_documents()
    sizes = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len(words_of(t))
    want = levels_by_hand(sizes)
    found = mixing.plan(docs.withColumn("copy", F.lit(1))).collect()
    assert len(found) == len(rows)
    by_target = {}
    for r in found:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        by_target.setdefault((r["source_size"], round(r["target"], 6)), []).append(r["taken"])
    assert sorted(by_target) == sorted((sizes[s], round(float(t), 6)) for s, t in want.items())
    longest = max(len(words_of(t)) for _, t, *_ in rows)
    for (_, target), taken in by_target.items():
        assert abs(sum(taken) - target) < longest


def test_mix_is_near_its_targets_and_the_same_again(spark):
    rnd = random.Random(5)
    rows = [(n, "w " * int(rnd.lognormvariate(4, 1)), "s%d" % min(rnd.randrange(12), 7)) for n in range(4000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    first = mixing.plan(frame).toPandas().sort_values("doc_id").reset_index(drop=True)
    again = mixing.plan(frame.repartition(11)).toPandas().sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(first, again)
    first["source"] = [s for _, _, s in rows]
    per = first.groupby("source").agg({"taken": "sum", "target": "first", "source_size": "first"})
    assert ((per["taken"] - per["target"]).abs() < 0.01 * per["target"]).all()
    assert abs(per["target"].sum() - 1.5 * per["source_size"].sum()) < 1e-6


def test_mix_emits_the_documents(spark, docs):
    mix = mixing.mixed(docs)
    assert mix.columns == [*docs.columns, "copy"]
    by_text = mix.groupBy("doc_id", "source", "text").count().collect()
    words = {}
    for r in by_text:
        words[r["source"]] = words.get(r["source"], 0) + r["count"] * len(words_of(r["text"]))
    plan = mixing.sample(mixing.sizes(docs, carry=["source"])).groupBy("source").agg(F.sum(F.col("size") * F.col("copies"))).collect()
    assert {s: n for s, n in words.items() if n} == {s: n for s, n in plan if n}


def test_mix_of_nothing_and_of_blanks(spark, docs):
    assert mixing.plan(docs.limit(0)).count() == 0
    blank = mixing.plan(docs.withColumn("text", F.lit(" "))).collect()
    assert len(blank) == docs.count() and {(r["size"], r["target"], r["taken"]) for r in blank} == {(0, 0.0, 0)}
