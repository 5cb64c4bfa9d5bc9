"""Licence scan by canonical digests. DataFrame functions only.

A text is made canonical: A-Z lower-cased, copyright lines dropped, equivalent spellings made one, punctuation and
white space reduced to single spaces. The SHA-256 digest of the whole canonical text, and that of every line on its own, is
hash-joined to the digests of known licence texts and notices, made canonical alike.

The built-in list has whole texts of short licences, with their title line and without, notices of longer ones, and one-line statements.
One result row per input row, scope ('document' or 'line') and known text found; a line that repeats within a document
counts once. Very long texts are whole texts like others, and very long lines lines. Null and empty texts hold nothing and give no row; repeated rows each give theirs; null ids are carried; an empty table gives
an empty result; other columns are ignored. Nothing is grouped, so frequent sources and copies stay spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicegrid.llm.license_texts import TEXTS

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COPYRIGHT_LINE = r"(?m)^[ \t*#/;-]*(?:copyright|©|\(c\)|all rights reserved)[^\n]*$"
PUNCTUATION = "[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F©«»–—‘’“”… ]+"
# Spellings that count as one (pattern, form used here), after lower-casing.
EQUIVALENT = (
    ("licence", "license"), ("licenc", "licens"), ("organisation", "organization"), ("favour", "favor"),
    ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability"), ("non-commercial", "noncommercial"),
    ("copyright owner", "copyright holder"), ("http://", "https://"), ("per cent", "percent"),
)
# Licence ids and the texts that state them.
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    *TEXTS,
)


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text that are not empty."""
    t = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, UPPER.lower())
    # Lines end at line feeds only, not at the other separators that Java knows.
    t = F.regexp_replace(t, "(?d)" + COPYRIGHT_LINE, "")
    for spelling, form in EQUIVALENT:
        t = F.replace(t, F.lit(spelling), F.lit(form))
    lines = F.split(F.regexp_replace(t, PUNCTUATION, " "), "\n", -1)
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def known_digests(known: DataFrame) -> DataFrame:
    """(license_id, license_sha256), once each, of known texts (license_id, text)."""
    lines = canonical_lines(F.col("text"))
    return known.select("license_id", digest(F.array_join(lines, " ")).alias("license_sha256")).distinct()


def scan(docs: DataFrame, known: DataFrame | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, scope, license_id, license_sha256). `known` (license_id, text) replaces the built-in list.

    The built-in list is a constant of this file and is broadcast; for a table of the user's Spark decides by its size.
    """
    if known is None:
        spark = docs.sparkSession
        digests = F.broadcast(known_digests(spark.createDataFrame(list(KNOWN), "license_id string, text string")))
    else:
        digests = known_digests(known)
    rows = docs.select(F.col(id_column).alias("doc_id"), canonical_lines(F.col(text)).alias("lines"))
    whole = F.array(F.struct(F.lit("document").alias("scope"), F.array_join("lines", " ").alias("body")))
    each = F.transform(F.array_distinct("lines"), lambda x: F.struct(F.lit("line").alias("scope"), x.alias("body")))
    units = rows.filter(F.size("lines") > 0).select("doc_id", F.explode(F.concat(whole, each)).alias("unit"))
    keyed = units.select("doc_id", "unit.scope", digest(F.col("unit.body")).alias("license_sha256"))
    return keyed.join(digests, "license_sha256").select("doc_id", "scope", "license_id", "license_sha256")
