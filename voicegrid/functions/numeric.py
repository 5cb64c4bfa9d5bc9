"""Number, date and identity expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voicegrid.config import CONFIDENCE_BINS


def to_number(value: Column) -> Column:
    """Double, or null for anything that is not a number (NaN included)."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value; null stays null."""
    bounded = value
    if low is not None:
        bounded = F.greatest(bounded, F.lit(float(low)))
    if high is not None:
        bounded = F.least(bounded, F.lit(float(high)))
    return F.when(value.isNotNull(), bounded)


def log1p(value: Column) -> Column:
    return F.log1p(value)


def round_even(value: Column, digits: int) -> Column:
    """Round half to even; the built-in `round` rounds half up."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def rate(share: Column) -> Column:
    """Share as a percentage with one decimal."""
    return F.rint(share * 1000.0) / 10.0


def month(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM")


def parse_installs(text: Column) -> Column:
    """'500,000,000+' to 500000000; no digits to 0."""
    digits = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("0")), r"[^0-9]", "")
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def priority_band(score: Column) -> Column:
    return F.when(score <= 4.0, "Low").when(score <= 6.5, "Medium").when(score > 6.5, "High")


def confidence_bin(confidence: Column) -> Column:
    """Histogram label; bins are closed on the right and the first one holds 0."""
    chain = F.when(confidence < 0, F.lit(None).cast("string"))
    for upper, label in CONFIDENCE_BINS:
        chain = chain.when(confidence <= upper, label)
    return chain


def content_id(path: Column, index: Column) -> Column:
    """Stable identity of a paragraph: digest of `path:index`."""
    return F.sha2(F.concat_ws(":", path, index.cast("string")), 256)
