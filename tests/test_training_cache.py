"""What training keeps in memory, and how ensembles are trained side by side."""

from voicegrid.operators import classify


def test_training_keeps_counts_and_no_terms(spark, monkeypatch):
    kind = type(spark.range(1))
    original, kept = kind.persist, []

    def noted(self, *level):
        kept.append(set(self.columns))
        return original(self, *level)

    monkeypatch.setattr(kind, "persist", noted)
    rows = [(i, f"{'crash bug' if i % 2 else 'love colours'} word{i % 5} again", "Bug" if i % 2 else "Praise") for i in range(60)]
    df = spark.createDataFrame(rows, "review_seq long, review_text string, category string")
    _, predictions = classify.train(df, balanced=True, iterations=5)
    assert kept == [{"category", "counts", "class_weight"}]
    assert all(r["actual"] == r["predicted"] for r in predictions.collect())


def test_ensembles_are_trained_side_by_side_on_one_partition_a_core(spark, monkeypatch):
    import threading

    from voicegrid.operators import trees

    original, seen = trees.GBTClassifier.fit, []

    def noted(self, rows, *more):
        seen.append((threading.current_thread() is threading.main_thread(), rows.rdd.getNumPartitions()))
        return original(self, rows, *more)

    monkeypatch.setattr(trees.GBTClassifier, "fit", noted)
    rows = [(i, f"{'crash bug' if i % 2 else 'love colours'} word{i % 5} again", "Bug" if i % 2 else "Praise") for i in range(60)]
    df = spark.createDataFrame(rows, "review_seq long, review_text string, category string").repartition(40)
    model = trees.fit_trees(classify.with_terms(df), rounds=1, depth=2)
    assert list(model.ensembles) == ["Bug", "Praise"]
    assert len(seen) == 2 and not any(main for main, _ in seen)
    assert max(n for _, n in seen) <= spark.sparkContext.defaultParallelism
