import itertools
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from voicegrid.operators import dedupe, priority
from voicegrid.operators.sentiment import add_sentiment

T = 0.9


def brute_force(rows):
    """{seq: (group, count)} per app by comparing every pair of reviews."""
    result = {}
    apps = {}
    for seq, app, text in sorted(rows):
        apps.setdefault(app, []).append((seq, text or ""))
    for members in apps.values():
        bags = {}
        for seq, text in members:
            tokens = re.findall(r"\w{2,}", text.lower())
            bags[seq] = Counter(tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])])
        df = Counter(t for bag in bags.values() for t in bag)
        unit = {}
        for seq, bag in bags.items():
            w = {t: n * (math.log((1 + len(members)) / (1 + df[t])) + 1) for t, n in bag.items()}
            length = math.sqrt(sum(x * x for x in w.values()))
            unit[seq] = {t: x / length for t, x in w.items()} if length else {}
        root = {seq: seq for seq in unit}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in itertools.combinations(unit, 2):
            if sum(x * unit[b].get(t, 0) for t, x in unit[a].items()) >= T - 1e-9:
                ra, rb = sorted((find(a), find(b)))
                root[rb] = ra
        order = {r: i for i, r in enumerate(sorted({find(s) for s in unit}), 1)}
        sizes = Counter(find(s) for s in unit)
        trivial = len(members) < 2 or all(not text.strip() for _, text in members)
        for i, seq in enumerate(sorted(unit)):
            result[seq] = (i, 1) if trivial else (order[find(seq)], sizes[find(seq)])
    return result


def grouped(spark, rows, **options):
    df = spark.createDataFrame(rows, "review_seq long, app_id string, review_text string")
    out = dedupe.add_duplicate_groups(df, **options).collect()
    assert len(out) == len(rows)
    return {r["review_seq"]: (r["duplicate_group"], r["duplicate_count"]) for r in out}, {r["dedupe_method"] for r in out}


def test_mixed_apps_match_brute_force(spark):
    base = [
        "please add a dark mode for the evening hours",
        "the sound stops after a phone call and never returns",
        "login loops forever since the last update came out",
        "lovely colours and very smooth scrolling all around",
    ]
    rows, seq = [], itertools.count(1)
    for app in ("one", "two"):
        for i in range(40):
            words = base[i % 4].split()
            if i % 5 == 0:
                words[i % len(words)] = f"word{i}"
            if i % 7 == 0:
                words += ["again", "please"]
            rows.append((next(seq), app, " ".join(words)))
        rows += [(next(seq), app, "👌"), (next(seq), app, "👌"), (next(seq), app, None), (next(seq), app, "x")]
    rows += [(next(seq), "single", "only one review here")]
    rows += [(next(seq), "blank", "  "), (next(seq), "blank", ""), (next(seq), "blank", None)]
    got, methods = grouped(spark, rows)
    assert got == brute_force(rows)
    assert methods == {"tfidf_fallback", "not_required"}


def test_hot_template_is_grouped_without_listing_its_pairs(spark):
    """A third of the table are copies of one template that differ in a number."""
    template = " ".join(f"part{i}" for i in range(110)) + " courier " + " ".join(f"part{i}" for i in range(110, 220))
    rows = [(i, "shop", f"{template} n{i:04d}") for i in range(0, 120)]
    rows += [(200 + i, "shop", f"completely different text number w{i} about topic z{i % 7} and nothing else v{i}") for i in range(120)]
    rows += [(400 + i, "shop", template.replace("courier", "driver") + f" m{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "review_seq long, app_id string, review_text string")
    units = dedupe.materialize(dedupe.collapse_copies(df), "u")
    links = dedupe.similarity_links(dedupe.materialize(dedupe.unit_vectors(units), "v")).count()
    got, _ = grouped(spark, rows)
    expected = brute_force(rows)
    assert got == expected
    largest = max(c for _, c in expected.values())
    assert largest >= 120
    # All pairs of the template alone would be more than 7000.
    assert links < 20 * len(rows)


def test_reviews_without_an_app_are_kept(spark):
    rows = [(1, None, "add dark mode please"), (2, None, "add dark mode please"), (3, "a", "add dark mode please"), (4, "a", "so slow")]
    got, _ = grouped(spark, rows)
    assert got == {1: (1, 2), 2: (1, 2), 3: (1, 1), 4: (2, 1)}


def test_threshold_moves_groups(spark):
    rows = [(1, "a", "add dark mode please now"), (2, "a", "add dark mode please"), (3, "a", "unrelated words entirely here"), (4, "a", "another thing")]
    strict, _ = grouped(spark, rows, threshold=0.99)
    loose, _ = grouped(spark, rows, threshold=0.6)
    assert strict[1][1] == 1 and loose[1] == loose[2] == (1, 2)


@pytest.fixture()
def insight_rows(spark):
    rows = [
        (1, "app", "Please give us a night theme", 4, 5, "Feature Request", 0.98),
        (2, "app", "Please give us a night theme", 3, 2, "Feature Request", 0.97),
        (3, "app", "It freezes, a bad crash and the worst", 1, 20, "Bug", 0.99),
        (4, "app", "Great and useful", 5, 1, "Praise", 0.99),
    ]
    schema = "review_seq long, app_id string, review_text string, rating int, thumbs_up int, category string, prediction_confidence double"
    return spark.createDataFrame(rows, schema)


def test_sentiment_duplicates_priority_and_ranking(spark, insight_rows):
    analyzed = priority.add_priority(dedupe.add_duplicate_groups(add_sentiment(insight_rows)))
    by_seq = {r["review_seq"]: r for r in analyzed.collect()}
    assert by_seq[3]["sentiment"] == "Negative" and by_seq[3]["sentiment_score"] == -3
    assert by_seq[4]["sentiment"] == "Positive"
    assert by_seq[3]["priority_score"] > by_seq[4]["priority_score"]
    assert by_seq[1]["duplicate_count"] == 2
    ranking = priority.with_rationale(priority.build_feature_ranking(analyzed)).collect()
    assert len(ranking) == 1 and ranking[0]["reach"] == 2
    assert ranking[0]["request"] == "Please give us a night theme"
    assert ranking[0]["rationale"].startswith("Ranked from 2 grouped request(s), average priority ")


def test_golden_priority_rows(spark):
    rows = [("Bug", 3, 6.02, "Medium"), ("Praise", 3, 2.52, "Low"), ("Bug", 4, 5.27, "Medium"), ("Bug", 1, 7.52, "High")]
    df = spark.createDataFrame(rows, "category string, rating int, score double, band string")
    scored = priority.add_priority(df.withColumn("thumbs_up", F.lit("0")))
    assert all(r["priority_score"] == r["score"] and r["priority"] == r["band"] for r in scored.collect())


def test_priority_defaults(spark):
    df = spark.createDataFrame([("Else", "bad"), (None, None), ("Bug", "9")], "category string, rating string")
    got = [r["priority_score"] for r in priority.add_priority(df).collect()]
    log2 = math.log(2) * 0.75
    assert got == [round(1 + 1.5 + log2, 3), round(1 + 1.5 + log2, 3), round(4 + log2, 3)]
