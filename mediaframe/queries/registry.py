"""Registered queries and their SQL oracles."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mediaframe.sources.fixtures import fixture, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Fixture views and base tables of one directory, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return fixture(self.spark, self.sf_dir, name)

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)


def query(body: str | None = None, *views: str, **named: str):
    """Registers a function of Tables under its name, with a DuckDB oracle unless `body` is None."""
    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if body is not None:
            ORACLES[f.__name__] = oracle(body, *views, **named)
        return f

    return register


AT = "coalesce(taken_at, added_at)"
#: Visible media with sort_at and period keys.
V = f"""SELECT m.*, {AT} AS sort_at, coalesce(strftime({AT}, '%Y-%m-%d'), 'undated') AS day_key, coalesce(strftime(date_trunc('week', {AT}), '%Y-%m-%d'), 'undated') AS week_key,
 coalesce(strftime({AT}, '%Y-%m'), 'undated') AS month_key, coalesce(strftime({AT}, '%Y'), 'undated') AS year_key
 FROM media m JOIN exposure x ON x.media_id = m.media_id AND x.content_revision = m.content_revision WHERE availability = 'AVAILABLE' AND exposure = 'SAFE'"""
EL = "SELECT m.* FROM media m JOIN exposure x ON x.media_id = m.media_id AND x.content_revision = m.content_revision WHERE availability = 'AVAILABLE' AND exposure = 'SAFE' AND trashed_at IS NULL"
M = ("media", "exposure")
