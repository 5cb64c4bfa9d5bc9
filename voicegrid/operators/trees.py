"""Boosted trees as an alternative to the linear classifier: chosen terms, one ensemble per label, normalised probabilities."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import IDF, CountVectorizerModel, ElementwiseProduct
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voicegrid.operators.classify import argmax_label, class_weights, confidence, stratified_split, with_terms
from voicegrid.operators.intake import require_columns
from voicegrid.operators.skew import join_frequent
from voicegrid.session import materialize

SELECTED = 500
ROUNDS, DEPTH, RATE, SHARE = 20, 5, 0.1, 0.9
# Rows that ensembles trained at one time hold in all: about 2 kB each.
ROWS_BESIDE = 6_000_000


def term_scores(rows: DataFrame, label: str = "category", terms: str = "terms", min_df: int = 2) -> DataFrame:
    """(term, df, score): chi-square of a term's presence against the label.

    One pass and one shuffle: documents are counted per term, one count to each label; labels are few.
    """
    label_rows = rows.groupBy(label).agg(F.count("*").cast("double").alias("label_rows")).collect()  # one row per label
    whole = sum(r["label_rows"] for r in label_rows)
    known = sorted(((r[label], r["label_rows"] / whole) for r in label_rows if r[label] is not None), key=lambda k: str(k[0]))
    if not known:
        return rows.sparkSession.createDataFrame([], "term string, df bigint, score double")
    counts = [F.count_if(F.col(label) == F.lit(name)).alias(f"held_{n}") for n, (name, _) in enumerate(known)]
    held = rows.filter(F.col(label).isNotNull()).select(label, F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(*counts)
    # sum over labels of (held - expected)^2 / expected, where the labels without the term add their expected count.
    squares = [F.col(f"held_{n}") * F.col(f"held_{n}") / F.lit(share) for n, (_, share) in enumerate(known)]
    df = [F.col(f"held_{n}") for n in range(len(known))]
    summed = held.select(
        "term", reduce(add, df).alias("df"), reduce(add, squares).alias("squares"), F.lit(whole).alias("rows")
    ).filter(F.col("df") >= min_df)
    inside = F.col("squares") / F.col("df") - F.col("df")
    # The counts of documents without the term deviate by as much from a larger, or smaller, expectation.
    outside = inside * F.col("df") / F.nullif(F.col("rows") - F.col("df"), F.lit(0.0))
    return summed.select("term", "df", (inside + F.coalesce(outside, F.lit(0.0))).alias("score"))


def select_terms(rows: DataFrame, count: int = SELECTED, label: str = "category", min_df: int = 2) -> list[str]:
    """The `count` terms that tell most about the label, best first: a bounded list."""
    best = term_scores(rows, label, min_df=min_df).orderBy(F.desc(F.round("score", 9)), "term").limit(count)
    return [r["term"] for r in best.collect()]


@dataclass(frozen=True)
class TreeModel:
    """Text features and one ensemble per label."""

    features: PipelineModel
    ensembles: dict[str, GBTClassificationModel]

    def transform(self, rows: DataFrame) -> DataFrame:
        """`rows` (review_text) with `probabilities` (by label, in order, summing to 1), `predicted` and `confidence`; no shuffle."""
        made = self.features.transform(with_terms(rows))
        names = list(self.ensembles)
        for n, ensemble in enumerate(self.ensembles.values()):
            made = ensemble.copy({ensemble.probabilityCol: "_p", ensemble.rawPredictionCol: "", ensemble.predictionCol: ""}).transform(made)
            made = made.withColumn(f"_p{n}", vector_to_array("_p")[1]).drop("_p")
        each = F.array(*[f"_p{n}" for n in range(len(names))])
        whole = F.aggregate(each, F.lit(0.0), lambda s, p: s + p)
        told = made.select(*rows.columns, F.transform(each, lambda p: p / whole).alias("probabilities"))
        return told.withColumns({
            "predicted": argmax_label(F.col("probabilities"), names), "confidence": confidence(F.col("probabilities")),
        })

    def save(self, folder: str) -> None:
        """Write the model; `load` reads it."""
        self.features.write().overwrite().save(f"{folder}/features")
        PipelineModel(stages=list(self.ensembles.values())).write().overwrite().save(f"{folder}/ensembles")
        SparkSession.getActiveSession().createDataFrame(list(enumerate(self.ensembles)), "n int, label string").coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{folder}/labels")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> TreeModel:
        labels = [r["label"] for r in spark.read.parquet(f"{folder}/labels").orderBy("n").collect()]
        return TreeModel(PipelineModel.load(f"{folder}/features"), dict(zip(labels, PipelineModel.load(f"{folder}/ensembles").stages, strict=True)))


def fit_trees(
    train_rows: DataFrame, label: str = "category", weight: str | None = None, selected: int = SELECTED, min_df: int = 2,
    rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, share: float = SHARE, seed: int = 42,
) -> TreeModel:
    """Train on rows with `terms`: term selection, smoothed TF-IDF, and boosted trees for every label against the others."""
    vocabulary = select_terms(train_rows, selected, label, min_df)
    if not vocabulary:
        raise RuntimeError("no term occurs often enough to learn from")
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="terms", outputCol="counts")
    counted = counter.transform(train_rows)
    rarity = IDF(inputCol="counts", outputCol="features").fit(counted).idf.toArray()
    features = PipelineModel(stages=[counter, ElementwiseProduct(inputCol="counts", outputCol="features", scalingVec=Vectors.dense(rarity + 1.0))])
    spark = train_rows.sparkSession
    # Every level of every round of every label is a job over the rows: they are stored, and read as one partition per core.
    stored = materialize(features.transform(train_rows).select(label, "features", *([weight] if weight else [])), "tree-rows")
    prepared = stored.coalesce(spark.sparkContext.defaultParallelism).persist()
    counted = {r[label]: r["count"] for r in prepared.groupBy(label).count().orderBy(label).collect()}  # one row per label

    def ensemble(name: str) -> GBTClassificationModel:
        learner = GBTClassifier(
            labelCol="_is", featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=share, seed=seed
        )
        learner = learner.setWeightCol(weight) if weight else learner
        return learner.fit(prepared.withColumn("_is", (F.col(label) == name).cast("double")))

    # Such jobs are short, so labels are trained side by side, as many as keep their binned rows in memory.
    beside = max(1, min(len(counted), ROWS_BESIDE // max(1, sum(counted.values()))))
    with ThreadPoolExecutor(beside) as pool:
        ensembles = dict(zip(counted, pool.map(inheritable_thread_target(spark)(ensemble), counted), strict=True))
    prepared.unpersist()
    return TreeModel(features, ensembles)


def train_trees(dataset: DataFrame, seq: str = "review_seq", seed: int = 42, balanced: bool = True, **options) -> tuple[TreeModel, DataFrame]:
    """(model, predictions on the held-out fifth), like `classify.train`; `balanced` weighs every label alike."""
    require_columns(dataset, "review_text", "category")
    split = stratified_split(dataset.dropna(subset=["review_text", "category"]), seq=seq, seed=seed)
    train_rows, weight = with_terms(split.filter(~F.col("is_test"))), None
    if balanced:
        weights = materialize(class_weights(train_rows), "weights")
        train_rows, weight = join_frequent(train_rows, weights, ["category"], "rows", stored=True), "class_weight"
    model = fit_trees(train_rows, weight=weight, seed=seed, **options)
    told = model.transform(split.filter("is_test").select(seq, "review_text", F.col("category").alias("actual")))
    return model, told.select(seq, "actual", "predicted", "confidence", "probabilities")
