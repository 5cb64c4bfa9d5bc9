"""Vectors of shared terms from blocks: equal to counting terms one by one, and small on disk."""

import math
import os
import random
from collections import Counter, defaultdict

from voicegrid.operators import dedupe
from voicegrid.session import shared_dir


def texts(count, words, seed=7):
    draw = random.Random(seed)
    return [(i, "ab"[i % 3 == 0], " ".join(f"word{draw.randrange(400)}" for _ in range(words))) for i in range(count)]


def stored_bytes(spark):
    return {os.path.join(r, f): os.path.getsize(os.path.join(r, f)) for r, _, names in os.walk(shared_dir(spark)) for f in names if f.endswith(".parquet")}


def test_vectors_equal_counting_one_by_one(spark, monkeypatch):
    from voicegrid.operators import term_blocks

    monkeypatch.setattr(term_blocks, "LEAST_BUCKETS", 5)
    rows = [*texts(60, 30), (100, "a", "word1"), (101, "a", "word1"), (102, "b", ""), (103, "b", "the same words twice twice"), (104, "b", "the same words twice")]
    df = spark.createDataFrame(rows, "review_seq long, app_id string, review_text string")
    found = dedupe.unit_vectors(dedupe.materialize(dedupe.collapse_copies(df), "u")).collect()
    bags, first = {}, {}
    for seq, app, text in rows:
        if text:
            words = text.split()
            bags.setdefault((app, text), Counter(words + [" ".join(p) for p in zip(words, words[1:])]))
            first.setdefault((app, text), seq)
    copies = Counter((app, text) for _, app, text in rows)
    sizes, df_of, users = Counter(app for _, app, _ in rows), Counter(), Counter()
    for (app, text), bag in bags.items():
        for term in bag:
            df_of[app, term] += copies[app, text]
            users[app, term] += 1
    expected = {}
    for (app, text), bag in bags.items():
        weights = {t: n * (math.log((1 + sizes[app]) / (1 + df_of[app, t])) + 1) for t, n in bag.items()}
        length = math.sqrt(sum(w * w for w in weights.values()))
        expected[first[app, text]] = sorted(round(w / length, 9) for t, w in weights.items() if users[app, t] > 1)
    assert {r["unit"]: sorted(round(t["w"], 9) for t in r["vector"]) for r in found} == {u: w for u, w in expected.items() if w}
    # The same term has the same key in every unit, and no other term has it.
    seen = defaultdict(int)
    for r in found:
        assert math.isclose(r["mass"], sum(t["w"] ** 2 for t in r["vector"]), rel_tol=1e-9)
        for t in r["vector"]:
            seen[t["k1"], t["k2"]] += 1
    assert sorted(seen.values()) == sorted(n for n in users.values() if n > 1)


def test_stored_tables_are_small(spark):
    """Terms were stored with two hashes each, and weights once more: 45 bytes a term in all."""
    rows = texts(300, 600)
    units = dedupe.materialize(dedupe.collapse_copies(spark.createDataFrame(rows, "review_seq long, app_id string, review_text string")), "u")
    before = stored_bytes(spark)
    vectors = dedupe.unit_vectors(units)
    terms = vectors.selectExpr("sum(size(vector))").first()[0]
    added = sum(n for path, n in stored_bytes(spark).items() if path not in before)
    assert terms > 100_000 and added < 10 * terms


def test_minhash_tells_terms_apart(spark):
    """A term is its two keys together: neither alone may serve as its identity."""
    rows = [(i, "a", f"{text} end{i}") for i, (_, _, text) in enumerate(t for t in texts(20, 120) for _ in range(2))]
    units = dedupe.materialize(dedupe.collapse_copies(spark.createDataFrame(rows, "review_seq long, app_id string, review_text string")), "u")
    vectors = dedupe.unit_vectors(units)
    exact = {(r["a"], r["b"]) for r in dedupe.similarity_links(vectors).select("a", "b").collect()}
    found = {(r["a"], r["b"]) for r in dedupe.minhash_links(vectors).select("a", "b").collect()}
    assert exact == {(i, i + 1) for i in range(0, 40, 2)} and found == exact
