"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence are combined for every row:
* text: naive Bayes over hashed character trigrams, trained on a bounded sample of labelled rows;
* the language that the markup declares, as a noisy observation;
* the address suffix and the host, as a prior. Expected languages (the posterior of text and declaration) are summed
  per suffix and host by grouped aggregation over all rows; a host's prior is smoothed by its suffix's, a suffix's by that of
  all rows, and the row's own share is taken out.

A flat background model stands for "none of the languages". A row is rejected if it holds no letter outside
chunks with digits, if the background wins, or if the
best language is less than `least` likely. Missing declaration, suffix or host leave their evidence out (a null host or suffix shares the
prior above it); a declared language that no labelled row has is no evidence. Null texts count as empty and are rejected. Repeated rows
are kept and judged alike; of equally likely languages the first by name is given. Very long texts are scored in slices. An empty table
gives an empty result. Without labelled rows nothing is known: every language is "und", and no row is rejected.
A host may hold a third of all rows: sums are combined before the shuffle, and frequent hosts are joined by broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voicegrid.llm.common import free_name, lookup_left
from voicegrid.llm.grams import trigram_buckets
from voicegrid.session import materialize

BITS = 14
# Bound of the sample that the text model is fitted on: rows per language.
FIT_ROWS = 1000
TEMPER = 0.5
TRUST = 0.9
LEAST = 0.5
SMOOTH_SUFFIX = 50.0
SMOOTH_HOST = 20.0
NONE = "und"


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]
    table: np.ndarray  # trigram bucket by language: log probabilities


# Chunks with a digit or an address sign are no language; other ASCII signs count as spaces.
_NO_LANGUAGE = re.compile(rb"(?<![^\x00-\x20])[^\x00-\x20]*[0-9@][^\x00-\x20]*")
_SIGNS = bytes(b if chr(b).isalpha() or b > 127 else 32 for b in range(256))


def readable(text: bytes) -> bytes:
    """The letters of a text that can tell its language."""
    return b" ".join(_NO_LANGUAGE.sub(b" ", text).translate(_SIGNS).split())


def fit(labelled: DataFrame, text: str = "text", language: str = "lang", rows_each: int = FIT_ROWS, bits: int = BITS) -> TextModel:
    """Text model of the languages of `labelled`; per language the `rows_each` rows first in a fixed random order count."""
    rows = labelled.select(F.col(language).alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    # Hashes are ranked, not texts; the chosen ones are at most rows_each per language. Of a language with more texts only
    # hashes below a cut are ranked, which about twice as many as needed pass: they fit one task, whatever the language's share.
    keyed = rows.withColumn("h", F.xxhash64("text"))
    hashes = materialize(keyed.select("lang", "h").distinct(), "language-hashes")
    counts = hashes.groupBy("lang").agg(F.count("*").alias("texts"))
    cut = lookup_left(hashes, materialize(counts, "language-counts"), ["lang"], "texts")
    place = (F.col("h") / float(1 << 63) + 1) / 2
    low = cut.filter(place * F.col("texts") <= 2.0 * rows_each + 100)
    chosen = low.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("h"))).filter(F.col("n") <= rows_each)
    chosen = materialize(chosen.select("lang", "h"), "language-sample")
    sample = keyed.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    sample = sample.select("lang", F.col("text").cast("binary").alias("text"))

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sums: dict[str, np.ndarray] = {}
            for lang, value in zip(part.column(0).to_pylist(), part.column(1)):
                found = np.bincount(trigram_buckets(readable(value.as_py()), bits), minlength=1 << bits)
                sums[lang] = sums.get(lang, 0) + found
            for lang, row in sums.items():
                at = np.flatnonzero(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(row[at])], names=["lang", "bucket", "n"]
                )

    sums = sample.mapInArrow(counted, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.collect()  # at most 2^bits rows per language
    languages = tuple(sorted({r["lang"] for r in found}))
    counts = np.full((1 << bits, len(languages)), 0.5)
    place = {lang: i for i, lang in enumerate(languages)}
    for r in found:
        counts[r["bucket"], place[r["lang"]]] += r["n"]
    table = np.log(counts / counts.sum(axis=0)) if languages else counts
    return TextModel(languages, table.astype(np.float32))


def with_text_evidence(rows: DataFrame, model: TextModel, text: str, name: str, temper: float = TEMPER) -> DataFrame:
    """`rows` with the array column `name`: per language, then for the background, the tempered log-likelihood; empty without a letter."""
    bits = int(np.log2(len(model.table)))
    sent = rows.sparkSession.sparkContext.broadcast(model.table)  # 2^bits by languages, whatever the input
    flat, count = -bits * np.log(2.0), len(model.languages)

    @F.pandas_udf("array<double>")
    def evidence(texts):
        table, out = sent.value, []
        for value in texts:
            raw = readable(bytes(value))
            if not count or not raw.strip():
                out.append([])
                continue
            at = trigram_buckets(raw, bits)
            # In slices, so that a very long text needs no wide table.
            total = sum((table[at[i:i + 65536]].sum(axis=0, dtype=np.float64) for i in range(0, len(at), 65536)), np.zeros(count))
            out.append([*(temper * total), temper * flat * len(at)])
        return texts.__class__(out)

    return rows.withColumn(name, evidence(F.coalesce(F.col(text).cast("binary"), F.lit(b""))))


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    weights = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(weights, lambda x: x / F.aggregate(weights, F.lit(0.0), lambda s, y: s + y))


def identify(
    rows: DataFrame, model: TextModel, text: str = "text", declared: str | None = None, host: str | None = None,
    suffix: str | None = None, trust: float = TRUST, least: float = LEAST, temper: float = TEMPER,
) -> DataFrame:
    """`rows` with language, confidence, text_language and rejected; columns of these names in `rows` are replaced."""
    results = ["language", "confidence", "text_language", "rejected"]
    inputs = [c for c in (text, declared, host, suffix) if c]
    kept = [c for c in rows.columns if c.lower() not in results or c in inputs]
    rows = rows.select(*kept)
    languages, size = model.languages, len(model.languages) + 1
    name = {k: free_name(rows, f"_{k}") for k in ("logs", "first", "host", "suffix", "joint", "prior", "s", "h", "held", "hn", "suffix_held", "sn", "p")}
    null = F.lit(None).cast("string")
    scored = with_text_evidence(rows, model, text, name["logs"], temper)
    listed = F.array(*[F.lit(x.lower()) for x in languages]) if languages else F.expr("cast(array() as array<string>)")
    said = F.lower(F.col(declared).cast("string")) if declared else null
    off = np.log((1 - trust) / max(1, size - 1))
    claim = F.transform(
        F.concat(listed, F.array(F.lit(NONE))),
        lambda x: F.when(F.array_contains(listed, said), F.when(x == said, float(np.log(trust))).otherwise(float(off))).otherwise(0.0),
    )
    has_text = F.size(name["logs"]) > 0
    joint = F.when(has_text, F.zip_with(name["logs"], claim, lambda a, b: a + b))
    scored = scored.withColumns({
        name["joint"]: joint,
        name["host"]: F.col(host).cast("string") if host else null,
        name["suffix"]: F.col(suffix).cast("string") if suffix else null,
    }).withColumn(name["first"], _softmax(F.col(name["joint"])))
    part = lambda c, i: F.coalesce(F.get(c, F.lit(i)), F.lit(0.0))
    first, shost, ssuffix = F.col(name["first"]), F.col(name["host"]), F.col(name["suffix"])
    by_host = scored.groupBy(ssuffix.alias("s"), shost.alias("h")).agg(
        F.count("*").alias("held"), *[F.sum(part(first, i)).alias(f"p{i}") for i in range(size)]
    )
    by_host = materialize(by_host, "host-languages")
    total = by_host.agg(*[F.coalesce(F.sum(f"p{i}"), F.lit(0.0)) for i in range(size)]).first()
    by_suffix = by_host.groupBy("s").agg(F.sum("held").alias("held"), *[F.sum(f"p{i}").alias(f"p{i}") for i in range(size)])
    vector = lambda: F.array(*[F.col(f"p{i}") for i in range(size)])
    hosts = by_host.filter("h IS NOT NULL").select("s", "h", "held", vector().alias("n"))
    suffixes = by_suffix.filter("s IS NOT NULL").select("s", "held", vector().alias("n"))
    no_sums = F.array(*[F.lit(0.0)] * size)
    # A null is no key: it gets a value that keys can't have.
    hosts = materialize(hosts.select(
        F.coalesce("s", F.lit("\0")).alias(name["s"]), F.col("h").alias(name["h"]), F.col("held").alias(name["held"]), F.col("n").alias(name["hn"])
    ), "hosts")
    suffixes = materialize(suffixes.select(
        F.col("s").alias(name["s"]), F.col("held").alias(name["suffix_held"]), F.col("n").alias(name["sn"])
    ), "suffixes")
    keyed = scored.withColumns({name["s"]: F.coalesce(ssuffix, F.lit("\0")), name["h"]: F.coalesce(shost, F.lit("\0"))})
    joined = lookup_left(lookup_left(keyed, hosts, [name["s"], name["h"]], name["held"]), suffixes, [name["s"]], name["suffix_held"])

    def smoothed(sums: Column, above: Column, strength: float) -> Column:
        # Without the row's own share.
        own = F.zip_with(sums, F.coalesce(first, no_sums), lambda n, p: F.greatest(n - p, F.lit(0.0)))
        all_ = F.aggregate(own, F.lit(0.0), lambda a, n: a + n)
        return F.zip_with(own, above, lambda n, p: (n + strength * p) / (all_ + strength))

    base = np.array([max(0.0, float(x)) for x in total]) + 1.0
    base /= base.sum()
    world = F.array(*[F.lit(float(x)) for x in base])
    joined = joined.withColumn(name["prior"], F.when(F.col(name["sn"]).isNotNull(), smoothed(F.col(name["sn"]), world, SMOOTH_SUFFIX)).otherwise(world))
    joined = joined.withColumn(
        name["prior"],
        F.when(F.col(name["hn"]).isNotNull(), smoothed(F.col(name["hn"]), F.col(name["prior"]), SMOOTH_HOST)).otherwise(F.col(name["prior"])),
    )
    final = _softmax(F.zip_with(name["joint"], name["prior"], lambda a, p: a + F.log(p)))
    joined = joined.withColumn(name["p"], final)
    every = F.array(*[F.lit(x) for x in (*languages, NONE)])
    best = lambda c: F.get(every, F.array_position(c, F.array_max(c)).cast("int") - 1)
    return joined.withColumns({
        "language": F.coalesce(best(F.col(name["p"])), F.lit(NONE)),
        "confidence": F.coalesce(F.array_max(name["p"]), F.lit(0.0)),
        "text_language": F.when(has_text, best(F.col(name["logs"]))).otherwise(NONE),
    }).withColumn(
        "rejected", (F.col("language") == NONE) | (F.col("confidence") < least) if languages else F.lit(False)
    ).select(*kept, *results)


def page_evidence(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """`pages` with text (markup taken out), declared (lang attribute of html), host and suffix; columns of these names are replaced.

    A null page is empty, a null or strange address has no host; both are missing evidence.
    """
    page, address = F.coalesce(F.col(html), F.lit("")), F.coalesce(F.col(url), F.lit(""))
    body = F.regexp_replace(page, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    host = F.lower(F.regexp_extract(address, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    stem = F.lower(F.regexp_extract(page, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]+)", 1))
    return pages.withColumns({
        "text": body, "declared": F.nullif(stem, F.lit("")), "host": F.nullif(host, F.lit("")),
        "suffix": F.nullif(F.regexp_extract(host, r"\.([a-z]+)$", 1), F.lit("")),
    })
