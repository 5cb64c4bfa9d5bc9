import random

import pytest
from pyspark.sql import functions as F

from voicegrid.operators import classify, trees

SCHEMA = "review_seq long, review_text string, category string"
SIGNS = {"Bug": ["crash", "error", "broken"], "Praise": ["great", "love", "best"], "UI Issue": ["button", "layout", "screen"]}


@pytest.fixture(scope="module")
def labelled(spark):
    rnd, rows = random.Random(4), []
    for n in range(360):
        label = rnd.choice(["Bug", "Praise", "Praise", "Praise", "UI Issue"])
        noise = [f"w{rnd.randrange(80)}" for _ in range(8)]
        rows.append((n, " ".join(noise + rnd.choices(SIGNS[label], k=2) + ([rnd.choice(SIGNS["Praise"])] if rnd.random() < 0.1 else [])), label))
    return spark.createDataFrame(rows, SCHEMA)


def test_trees_are_no_worse_than_the_linear_learner(spark, labelled, tmp_path):
    model, told = trees.train_trees(labelled, rounds=5, depth=3)
    told = told.cache()
    accuracy = told.agg(F.avg((F.col("actual") == F.col("predicted")).cast("double"))).first()[0]
    _, linear = classify.train(labelled, iterations=20)
    assert accuracy >= classify.accuracy(linear).first()["accuracy"] - 0.03 and accuracy > 0.85
    assert told.count() == 72
    for r in told.collect():
        assert abs(sum(r["probabilities"]) - 1) < 1e-9 and r["confidence"] == max(r["probabilities"])
    model.save(str(tmp_path / "m"))
    again = trees.TreeModel.load(spark, str(tmp_path / "m")).transform(labelled.limit(20)).collect()
    assert [r["predicted"] for r in again] == [r["predicted"] for r in model.transform(labelled.limit(20)).collect()]


def test_telling_terms_are_selected(labelled):
    chosen = trees.select_terms(classify.with_terms(labelled), 9)
    assert set(chosen) == {w for words in SIGNS.values() for w in words}


def test_nothing_to_learn_from(spark):
    with pytest.raises(RuntimeError, match="no term"):
        trees.fit_trees(classify.with_terms(spark.createDataFrame([(1, "single", "Bug")], SCHEMA)))
