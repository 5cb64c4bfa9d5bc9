"""Named queries with the SQL that states the same result."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voicegrid.session import shared_dir, tune
from voicegrid.sources.samples import DATED_SQL, REVIEWS_SQL, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, reviews: bool = False, dated: bool = False, ctes: str = "", recursive: bool = False):
    """Register a function of `Tables`; `sql` may use the named projections."""

    def register(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Tables(tune(spark), folder))

        run.__name__ = name
        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            parts = [p for p in (REVIEWS_SQL if reviews or dated else "", DATED_SQL if dated else "", ctes) if p]
            ORACLES[name] = (f"WITH {'RECURSIVE ' * recursive}{', '.join(parts)} " if parts else "") + sql
        return build

    return register


def scratch(tables: Tables, label: str) -> str:
    """New folder for a sink query, next to the intermediate tables."""
    return os.path.join(shared_dir(tables.spark), f"{label}-{uuid.uuid4().hex}")
