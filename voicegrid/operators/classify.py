"""Classifier: split, weights, training, scoring, routing and evaluation."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizerModel, ElementwiseProduct, IndexToString, Normalizer, StringIndexer
from pyspark.ml.linalg import Vectors
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voicegrid.config import CALIBRATION_THRESHOLDS, DEFAULTS
from voicegrid.functions import numeric, text
from voicegrid.operators.features import limit_vocabulary, term_stats, term_table
from voicegrid.operators.intake import require_columns
from voicegrid.operators.skew import join_frequent
from voicegrid.session import materialize

MAX_FEATURES = 30_000
SOURCE = "xgboost"
ADDED = (
    "clean_text", "category", "prediction_confidence", "vocabulary_hits",
    "review_route", "needs_human_review", "requires_llm_review", "classification_source",
)


# --- preparation ---------------------------------------------------------------

def label_index(df: DataFrame, column: str = "category") -> DataFrame:
    """(label, index) in alphabetical order from 0; one row per label."""
    labels = df.filter(F.col(column).isNotNull()).select(column).distinct()
    return labels.withColumn("label_index", F.row_number().over(W.orderBy(column)) - 1)


def class_weights(df: DataFrame, column: str = "category") -> DataFrame:
    """Balanced weight n / (classes x class rows) per label."""
    counts = df.groupBy(column).agg(F.count("*").alias("rows"))
    every = W.partitionBy(F.lit(1))
    weight = F.sum("rows").over(every) / (F.count("*").over(every) * F.col("rows"))
    return counts.select(column, "rows", weight.alias("class_weight"))


def test_quotas(df: DataFrame, column: str, fraction: float) -> DataFrame:
    """Test rows per label: ceil(fraction x rows) in all, shared out by largest remainder."""
    every = W.partitionBy(F.lit(1))
    counts = df.groupBy(column).agg(F.count("*").alias("label_rows"))
    total = F.ceil(F.sum("label_rows").over(every) * F.lit(fraction) - 1e-9)
    exact = total * F.col("label_rows") / F.sum("label_rows").over(every)
    shared = counts.withColumns({"_total": total, "_exact": exact}).withColumn("_floor", F.floor("_exact"))
    left = F.col("_total") - F.sum("_floor").over(every)
    place = F.row_number().over(every.orderBy(F.desc(F.round(F.col("_exact") - F.col("_floor"), 9)), column))
    quota = F.col("_floor") + (place <= left).cast("int")
    return shared.withColumn("quota", quota.cast("bigint")).select(column, "label_rows", "quota")


def stratified_split(
    df: DataFrame, column: str = "category", seq: str = "review_seq", fraction: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add `is_test`: per label exactly its quota of rows, in order of a seeded digest.

    Counts per (label, digest prefix) tell in which prefix the quota runs out;
    only the rows of that one prefix (1/65536 of a label) are ranked.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(seq).cast("string")))
    keyed = df.withColumn("_digest", digest).withColumn("_prefix", F.substring("_digest", 1, 4))
    quotas = test_quotas(df, column, fraction)
    running = F.sum("_n").over(W.partitionBy(column).orderBy("_prefix"))
    edges = (
        keyed.groupBy(column, "_prefix").agg(F.count("*").alias("_n"))
        .withColumn("_upto", running)
        .join(quotas, column)
        .filter((F.col("_upto") >= F.col("quota")) & (F.col("_upto") - F.col("_n") < F.col("quota")))
        .select(column, F.col("_prefix").alias("_edge"), (F.col("quota") - F.col("_upto") + F.col("_n")).alias("_take"))
    )
    bounds = quotas.join(edges, column, "left").select(
        column, "label_rows", F.coalesce("_edge", F.lit("")).alias("_edge"), F.coalesce("_take", F.lit(0)).alias("_take")
    )
    placed = join_frequent(keyed, materialize(bounds, "bounds"), [column], "label_rows", stored=True)
    clear = placed.filter("_prefix <> _edge").withColumn("is_test", F.col("_prefix") < F.col("_edge"))
    rank = F.row_number().over(W.partitionBy(column, "_prefix").orderBy("_digest", seq))
    edge = placed.filter("_prefix = _edge").withColumn("is_test", rank <= F.col("_take"))
    return clear.unionByName(edge).select(*df.columns, "is_test")


# --- model ---------------------------------------------------------------------

def with_terms(df: DataFrame, column: str = "review_text") -> DataFrame:
    """Model input: normalised text and its unigrams and bigrams."""
    from voicegrid.operators.features import terms_of

    return df.withColumn("clean_text", text.normalize(F.col(column))).withColumn("terms", terms_of(F.col("clean_text")))


def frequent_terms(rows: DataFrame, count: int = MAX_FEATURES, min_df: int = 2) -> list[str]:
    """The `count` most frequent of the `terms` that `min_df` rows hold, most frequent first and ties by term: a bounded list."""
    stats = term_stats(rows.select(F.inline(text.term_counts(F.col("terms")))))
    best = limit_vocabulary(stats, F.lit(float("inf")), min_df, max_features=count).select("term").collect()
    if not best:
        raise RuntimeError("no term occurs often enough to learn from")
    return [r["term"] for r in best]


def fit(train_rows: DataFrame, label: str = "category", weight: str | None = None,
        max_features: int = MAX_FEATURES, min_df: int = 2, iterations: int = 50, regularization: float = 0.001) -> PipelineModel:
    """Text features and a multinomial classifier as one pipeline, so they are saved together."""
    learner = LogisticRegression(
        featuresCol="features", labelCol="label", family="multinomial", maxIter=iterations, regParam=regularization
    )
    if weight:
        learner = learner.setWeightCol(weight)
    indexer = StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="error")
    labels = indexer.fit(train_rows)
    counter = CountVectorizerModel.from_vocabulary(frequent_terms(train_rows, max_features, min_df), inputCol="terms", outputCol="counts")
    # The learner reads its rows once per iteration. Counts are kept: the terms themselves are many times their size.
    counted = counter.transform(train_rows).select(label, "counts", *([weight] if weight else [])).persist()
    rarity = IDF(inputCol="counts", outputCol="scaled").fit(counted).idf.toArray()
    # The smoothed weight is one more than Spark's, so a term of all documents keeps some.
    weights = ElementwiseProduct(inputCol="counts", outputCol="scaled", scalingVec=Vectors.dense(rarity + 1.0))
    normalizer = Normalizer(inputCol="scaled", outputCol="features")
    model = learner.fit(labels.transform(normalizer.transform(weights.transform(counted))))
    counted.unpersist()
    names = IndexToString(inputCol="prediction", outputCol="predicted", labels=labels.labels)
    return PipelineModel(stages=[counter, weights, normalizer, model, names])


def vocabulary_of(model: PipelineModel) -> list[str]:
    return model.stages[0].vocabulary


def check_width(model: PipelineModel) -> None:
    """Text features and classifier must have the same width."""
    if len(vocabulary_of(model)) != _classifier(model).numFeatures:
        raise RuntimeError("classifier and text features differ in width: train and save them together")


def _classifier(model: PipelineModel):
    return next(stage for stage in model.stages if hasattr(stage, "numClasses"))


def vocabulary_hits(df: DataFrame, vocabulary: DataFrame, key: str, column: str, **options) -> DataFrame:
    """Distinct in-vocabulary terms per row, 0 when there is none; the vocabulary's size decides how it is joined."""
    known = vocabulary.select("term")
    found = (
        term_table(df, key, column, **options)
        .join(known, "term", "left_semi")
        .groupBy(key)
        .agg(F.count("*").alias("vocabulary_hits"))
    )
    return df.join(found, key, "left").withColumn("vocabulary_hits", F.coalesce("vocabulary_hits", F.lit(0)))


def confidence(probabilities: Column) -> Column:
    """Highest class probability; 1.0 when the model gives none."""
    return F.coalesce(F.array_max(probabilities), F.lit(1.0))


def argmax_label(probabilities: Column, labels) -> Column:
    """Label of the highest probability, the first one on ties."""
    best = F.array_position(probabilities, F.array_max(probabilities)).cast("int")
    return F.when(probabilities.isNotNull(), F.element_at(F.array(*[F.lit(label) for label in labels]), best))


def route(df: DataFrame, threshold: float = DEFAULTS.classification_threshold, source: str = SOURCE) -> DataFrame:
    """Routing columns from prediction_confidence and vocabulary_hits."""
    low = F.col("prediction_confidence") < threshold
    path = (
        F.when(low & (F.col("vocabulary_hits") == 0), "translation_or_human")
        .when(low, "llm_ambiguity")
        .otherwise("model_confident")
    )
    routed = df.withColumns({"review_route": path, "needs_human_review": low})
    return routed.withColumns({
        "requires_llm_review": F.col("review_route") == "llm_ambiguity",
        "classification_source": F.lit(source),
    })


def score(df: DataFrame, model: PipelineModel, threshold: float = DEFAULTS.classification_threshold,
          source: str = SOURCE) -> DataFrame:
    """Add clean_text, category, prediction_confidence, vocabulary_hits and the routing columns; no shuffle."""
    require_columns(df, "review_text")
    check_width(model)
    scored = model.transform(with_terms(df)).withColumns({
        "category": F.col("predicted"),
        "prediction_confidence": confidence(vector_to_array("probability")),
        # The count vector is sparse: its entries are the in-vocabulary terms of the row.
        "vocabulary_hits": F.size(F.unwrap_udt("counts")["indices"]).cast("bigint"),
    })
    kept = scored.select(*[c for c in df.columns if c not in ADDED], *ADDED[:4])
    return route(kept, threshold, source)


def train(dataset: DataFrame, seq: str = "review_seq", seed: int = 42, balanced: bool = False, **options):
    """(model, predictions on the held-out fifth)."""
    require_columns(dataset, "review_text", "category")
    clean = dataset.dropna(subset=["review_text", "category"])
    split = with_terms(stratified_split(clean, seq=seq, seed=seed))
    train_rows = split.filter(~F.col("is_test"))
    weight = None
    if balanced:
        weights = materialize(class_weights(train_rows), "weights")
        train_rows = join_frequent(train_rows, weights, ["category"], "rows", stored=True)
        weight = "class_weight"
    model = fit(train_rows, weight=weight, **options)
    held_out = model.transform(split.filter("is_test"))
    predictions = held_out.select(
        seq, F.col("category").alias("actual"), "predicted", confidence(vector_to_array("probability")).alias("confidence")
    )
    return model, predictions


def metrics(predictions: DataFrame) -> dict[str, DataFrame]:
    """What a training reports about its held-out rows: report, diagnostics and calibration of the confidence."""
    from voicegrid.operators.summary import confidence_diagnostics

    spans = confidence_diagnostics(predictions.withColumnRenamed("confidence", "prediction_confidence"), 4)
    return {"report": class_report(predictions), "diagnostics": spans, "calibration": calibration(predictions)}


# --- evaluation ----------------------------------------------------------------

def accuracy(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.avg((F.col("actual") == F.col("predicted")).cast("double")).alias("accuracy"))


def confusion_pairs(predictions: DataFrame) -> DataFrame:
    """Rows per (actual, predicted): all the evaluation needs, labels x labels rows."""
    return predictions.groupBy("actual", "predicted").agg(F.count("*").alias("n"))


def confusion_matrix(predictions: DataFrame, labels) -> DataFrame:
    """One row per actual label, one column per predicted label."""
    counted = predictions.groupBy("actual").pivot("predicted", list(labels)).agg(F.count("predicted"))
    return counted.na.fill(0)


def class_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per label, then accuracy and the two averages."""
    pairs = confusion_pairs(predictions)
    actual = pairs.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("support"))
    predicted = pairs.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("called"))
    right = pairs.filter("actual = predicted").select(F.col("actual").alias("label"), F.col("n").alias("hits"))
    joined = actual.join(predicted, "label", "full").join(right, "label", "left").na.fill(0)

    def ratio(top, bottom):
        return F.coalesce(top / F.nullif(bottom, F.lit(0)), F.lit(0.0))

    per_label = joined.select(
        "label",
        ratio(F.col("hits"), F.col("called")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(2.0 * F.col("hits"), F.col("called") + F.col("support")).alias("f1"),
        "support",
        "hits",
    )
    scores = ("precision", "recall", "f1")
    everything = F.sum("support")
    macro = per_label.agg(*[F.avg(c).alias(c) for c in scores], everything.alias("support")).withColumn("label", F.lit("macro avg"))
    weighted = per_label.agg(
        *[(F.sum(F.col(c) * F.col("support")) / everything).alias(c) for c in scores], everything.alias("support")
    ).withColumn("label", F.lit("weighted avg"))
    overall = per_label.agg(*[(F.sum("hits") / everything).alias(c) for c in scores], everything.alias("support")).withColumn(
        "label", F.lit("accuracy")
    )
    return per_label.drop("hits").unionByName(overall).unionByName(macro).unionByName(weighted)


def calibration(predictions: DataFrame, thresholds=CALIBRATION_THRESHOLDS) -> DataFrame:
    """Coverage and accuracy of the rows kept at each threshold: one pass, then unpivoted."""
    right = F.col("actual") == F.col("predicted")
    measures = [F.count("*").alias("rows")]
    for i, t in enumerate(thresholds):
        kept = F.col("confidence") >= t
        measures += [F.count_if(kept).alias(f"kept_{i}"), F.count_if(kept & right).alias(f"right_{i}")]
    counted = predictions.agg(*measures)
    entries = F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"kept_{i}").alias("kept"), F.col(f"right_{i}").alias("right"))
        for i, t in enumerate(thresholds)
    ])
    return counted.select("rows", F.inline(entries)).select(
        "threshold",
        numeric.round_even(F.col("kept") / F.col("rows"), 4).alias("coverage"),
        numeric.round_even(F.coalesce(F.col("right") / F.nullif(F.col("kept"), F.lit(0)), F.lit(0.0)), 4).alias(
            "accuracy_when_retained"
        ),
    )


def class_distribution(df: DataFrame, column: str = "category") -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), column)
