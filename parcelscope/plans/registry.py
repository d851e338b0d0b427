"""Registered queries: a Spark job and, where SQL can say it, the same result as plain SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators import leads, report, resolve, score
from ..session import HUGE_METHOD
from . import sample_tables as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SQL: dict[str, str] = {}  # as written, without the tables it refers to


class Tables:
    """The engine's tables over one data folder, built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set(*HUGE_METHOD)
        self.spark, self.dir = spark, sf_dir
        self.as_of = S.AS_OF

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or not hasattr(S, name):
            raise AttributeError(name)
        table = getattr(S, name)(self.spark, self.dir)
        self.__dict__[name] = table
        return table

    def raw(self, name: str) -> DataFrame:
        return S.read(self.spark, self.dir, name)

    @cached_property
    def scores(self) -> DataFrame:
        return score.score_parcels(self.signals, self.properties, self.as_of)

    @cached_property
    def name_index(self) -> DataFrame:
        return resolve.build_name_index(self.properties)

    def report(self, hours: int = 168, limit: int = 400, **kw) -> DataFrame:
        return report.daily_report(
            self.signals, self.properties, self.scores, self.as_of, hours, limit, **kw
        )

    @cached_property
    def by_signal(self) -> DataFrame:
        return leads.summary_by_signal(self.scores)


def query(name: str, sql: str | None = None):
    """Register fn(Tables) -> DataFrame; `sql` may use the tables of oracle_tables by name."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            from .oracle_tables import with_tables

            SQL[name], ORACLE[name] = sql, with_tables(sql)
        return fn

    return wrap
