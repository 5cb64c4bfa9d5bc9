"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or abstain on every document. There are at most 3^m patterns of votes, so expectation
maximisation, which finds the share of good documents and how often each labeller is right on good and on bad
ones, needs the pattern counts of all documents only. The posterior of its pattern is a document's weak label. A
linear scorer over hashed character trigrams is trained on the weak labels of a bounded sample (`fit_rows`) and scores every document.

Null texts count as empty; an empty text gets votes and a score like any other (no trigrams: the bias alone). Repeated rows and null ids are
kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voicegrid.llm.grams import trigram_buckets
from voicegrid.session import materialize

BITS = 12
FIT_ROWS = 6000
GOOD, BAD, SKIP = 1, 0, 2
_WORD = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
_MARKS = re.compile(rb"[#$%&*|<>{}~^=\\]|!!")


def votes(text: bytes) -> list[int]:
    """One vote of each labeller on a text's UTF-8 bytes."""
    tokens, size = text.split(), len(text)
    if not tokens:
        return [BAD, SKIP, SKIP, SKIP, SKIP, SKIP]
    count, marks = len(tokens), len(_MARKS.findall(text)) / size
    words = _WORD.findall(text)
    short = sum(len(w) <= 3 for w in words) / max(1, len(words))
    mean = sum(map(len, words)) / max(1, len(words))
    ends = (text.count(b".") + text.count(b"!") + text.count(b"?") + text.count(b",")) / count
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = max(1 - len(set(lines)) / len(lines), sum(map(eq, tokens, tokens[1:])) / count)
    pipes = text.count(b"|") / count
    upper = sum(map(bytes.isupper, words)) / max(1, len(words))
    return [
        BAD if marks > 0.015 else SKIP,
        BAD if pipes > 0.05 else SKIP,
        BAD if upper > 0.2 and len(words) > 4 else SKIP,
        BAD if repeated > 0.15 else SKIP,
        GOOD if short > 0.25 and mean < 6.5 else BAD if short < 0.15 and mean > 7.5 else SKIP,
        GOOD if 0.02 < ends < 0.4 and marks < 0.002 else SKIP,
    ]


LABELLERS = len(votes(b""))


# What labellers are believed to do: shares of bad, good and no vote on bad and on good documents.
BELIEF = np.array([[0.55, 0.05, 0.40], [0.02, 0.58, 0.40]])


def expectation_maximisation(
    patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, strength: float = 0.02
) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good per pattern, share[labeller, class, vote], share of good) from vote patterns and their counts.

    An abstention is an outcome like the votes, so a labeller that only ever finds faults tells something by its silence too.
    Begins with the majority vote. A prior worth `strength` of all documents says what labellers tend to do, so the classes keep their meaning.
    """
    shown = np.stack([patterns == v for v in (BAD, GOOD, SKIP)], axis=2).astype(float)
    good, bad = shown[:, :, 1].sum(axis=1), shown[:, :, 0].sum(axis=1)
    posterior = np.where(bad > 0, 0.2, 0.5 + 0.5 * good / patterns.shape[1])
    weight, shares, share = 1 + strength * counts.sum(), np.tile(BELIEF, (patterns.shape[1], 1, 1)), 0.5
    for _ in range(rounds):
        share = ((counts * posterior).sum() + 1) / (counts.sum() + 2)
        logs = []
        for k, part in enumerate((1 - posterior, posterior)):
            sums = np.einsum("p,plv->lv", counts * part, shown) + weight * BELIEF[k]
            shares[:, k] = sums / sums.sum(axis=1, keepdims=True)
            logs.append(np.einsum("plv,lv->p", shown, np.log(shares[:, k])))
        after = 1 / (1 + np.exp(np.clip(logs[0] + np.log(1 - share) - logs[1] - np.log(share), -500, 500)))
        done = np.abs(after - posterior).max(initial=0.0) < 1e-9
        posterior = after
        if done:
            break
    return posterior, shares, float(share)


def features(text: bytes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values): square roots of the shares of hashed trigrams, so values have length one."""
    at = trigram_buckets(text, bits)
    if not len(at):
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    counts = np.bincount(at, minlength=1 << bits)
    where = np.flatnonzero(counts)
    return where, np.sqrt(counts[where] / len(at))


def train(matrix: np.ndarray, target: np.ndarray, steps: int = 300, rate: float = 2.0, penalty: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) of a logistic scorer for soft targets, by gradient steps with momentum."""
    weights = np.zeros(matrix.shape[1] + 1)
    speed = np.zeros_like(weights)
    kind = matrix.dtype  # a product of two kinds would copy the whole matrix in every step
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(matrix @ weights[:-1].astype(kind) + weights[-1])))
        gap = p - target
        slope = np.append(matrix.T @ gap.astype(kind) / len(target) + penalty * weights[:-1], gap.mean())
        speed = 0.9 * speed - rate * slope
        weights += speed
    return weights


def score(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS, bits: int = BITS, least: float = 0.5
) -> DataFrame:
    """(doc_id, weak_label, score, good) of every document; good is score >= `least`."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    spark = docs.sparkSession

    def voted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            cast = [sum(v * 3**i for i, v in enumerate(votes(x.as_py()))) for x in part.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(cast, pa.int64())], names=["pattern"])

    counted = rows.select("text").mapInArrow(voted, "pattern bigint").groupBy("pattern").agg(F.count("*").alias("n")).collect()
    numbers = np.array([r["pattern"] for r in counted], dtype=np.int64)  # at most 3^labellers rows
    patterns = numbers[:, None] // 3 ** np.arange(LABELLERS) % 3
    posterior, _, share = expectation_maximisation(patterns, np.array([r["n"] for r in counted], dtype=float))
    weak = dict(zip(numbers.tolist(), posterior.tolist()))

    def sampled(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [(x.as_py(), *features(x.as_py(), bits)) for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([
                part.column(0),
                pa.array([weak.get(sum(v * 3**i for i, v in enumerate(votes(t))), share) for t, _, _ in found]),
                pa.array([b.tolist() for _, b, _ in found], pa.list_(pa.int32())),
                pa.array([v.tolist() for _, _, v in found], pa.list_(pa.float32())),
            ], names=["h", "target", "buckets", "shares"])

    # Different texts, in a fixed random order; the sample's features are at most fit_rows by 2^bits numbers.
    order = rows.select(F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(fit_rows)
    chosen = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(materialize(order, "quality-sample")), "h", "left_semi")
    chosen = chosen.groupBy("h").agg(F.min("text").alias("text")).select("h", "text")
    matrix, target = np.zeros((fit_rows, 1 << bits), dtype=np.float32), np.zeros(fit_rows)
    used = 0
    for r in chosen.mapInArrow(sampled, "h bigint, target double, buckets array<int>, shares array<float>").orderBy("target", "h").toLocalIterator():
        matrix[used, r["buckets"]] = r["shares"]
        target[used], used = r["target"], used + 1
    weights = train(matrix[:used], target[:used]) if used else np.zeros((1 << bits) + 1)
    sent = spark.sparkContext.broadcast(weights)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def scored(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for part in parts:
            labels, scores = [], []
            for x in part.column(1):
                t = x.as_py()
                where, values = features(t, bits)
                labels.append(weak.get(sum(v * 3**i for i, v in enumerate(votes(t))), share))
                scores.append(float(1 / (1 + np.exp(-(values @ w[where] + w[-1])))))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(labels, pa.float64()), pa.array(scores, pa.float64()), pa.array([s >= least for s in scores], pa.bool_())],
                names=["doc_id", "weak_label", "score", "good"],
            )

    return rows.mapInArrow(scored, f"doc_id {kind}, weak_label double, score double, good boolean")
