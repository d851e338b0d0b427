"""The daily run: merge, resolve, score, report, match, volume check.

Each stage writes its table once and the next stage reads it back, so a lost executor or a repeated
run starts from the last table written, not from the feeds.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import match, merge, monitor, report, resolve, score
from ..schemas import SCRAPE_RUNS, SIGNALS
from ..sources import sinks


@dataclass
class Store:
    """Tables of one folder, each as one snapshot per day of the run."""

    spark: SparkSession
    root: str
    day: str

    def path(self, table: str) -> str:
        return f"{self.root}/{table}/day={self.day}"

    def write(self, table: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(table))
        return self.spark.read.parquet(self.path(table))

    def before(self, table: str, schema: str) -> DataFrame:
        """The newest snapshot older than this day; empty on the first run."""
        try:
            days = self.spark.read.schema(schema + ", day date").parquet(f"{self.root}/{table}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)  # nothing stored yet
        older = days.where(F.col("day") < F.lit(self.day).cast("date"))
        newest = older.select("day").distinct().agg(F.max("day")).scalar()
        return older.where(F.col("day") == newest).drop("day")


class DailyRun:
    """One day's tables. `records` is a batch in the record layout with its ingest sequence."""

    def __init__(
        self, spark: SparkSession, root: str, records: DataFrame, properties: DataFrame,
        prospects: DataFrame, as_of: str, hours: int = 24, match_hours: int = 168,
    ):
        self.records, self.properties, self.prospects = records, properties, prospects
        self.as_of, self.hours, self.match_hours = as_of, hours, match_hours
        day = spark.range(1).select(D.phoenix_date(D.as_of_col(as_of)).cast("string")).first()[0]
        self.store = Store(spark, root, day)

    @cached_property
    def merged(self) -> DataFrame:
        existing = self.store.before("signals", SIGNALS)
        snapshot, _ = merge.merge_signals(existing, self.records, self.as_of)
        return self.store.write("merged", snapshot)

    @cached_property
    def runs(self) -> DataFrame:
        """The run log: earlier rows plus one per source of this batch, drops marked as warnings."""
        log = self.store.before("runs", SCRAPE_RUNS)
        existing = self.store.before("signals", SIGNALS)
        today = monitor.run_metrics(
            merge.merge_metrics(existing, self.records), self.records, self.as_of
        )
        both = log.unionByName(today)
        return self.store.write(
            "runs", monitor.mark_run_warn(both, self.volume(today, log), self.store.day)
        )

    def volume(self, today: DataFrame, log: DataFrame) -> DataFrame:
        found = today.select("source", "status", F.col("rows_found").alias("found"))
        return monitor.volume_drop(found, monitor.recent_median(log, self.as_of))

    @cached_property
    def signals(self) -> DataFrame:
        resolved, _ = resolve.resolve_signals(self.merged, self.properties)
        return self.store.write("signals", resolved)

    @cached_property
    def scores(self) -> DataFrame:
        return self.store.write(
            "scores", score.score_parcels(self.signals, self.properties, self.as_of)
        )

    def report(self, hours: int, limit: int) -> DataFrame:
        return report.daily_report(
            self.signals, self.properties, self.scores, self.as_of, hours, limit
        )

    @cached_property
    def matches(self) -> DataFrame:
        pool = match.lead_pool(self.report(self.match_hours, match.POOL))
        rows = match.match_rows(match.match_leads(self.prospects, pool), pool, self.store.day)
        return self.store.write("matches", rows)

    def write_report(self) -> None:
        counts = report.report_counts(self.signals, self.properties, self.as_of, self.hours)
        sinks.sink_report_markdown(
            self.report(self.hours, 50), counts, self.store.path("report"), self.as_of, self.hours
        )

    def write_matches(self) -> None:
        shaped = match.prospect_match_shape(self.matches, self.prospects)
        sinks.sink_matches_json(shaped, self.store.path("matches_json"))

    def health(self) -> DataFrame:
        """This day's volume check, critical sources included."""
        log = self.runs.where(F.col("started_at") < D.as_of_col(self.as_of))
        today = self.runs.where(F.col("started_at") == D.as_of_col(self.as_of))
        # A warned run was an ok run; judge it again on its counts.
        return self.volume(today.withColumn("status", F.lit("ok")), log)

    def run(self) -> DataFrame:
        """All stages; returns the volume check."""
        self.write_report()
        self.write_matches()
        health = self.health()
        found = self.runs.where(F.col("started_at") == D.as_of_col(self.as_of)).select(
            "source", "status", F.col("rows_found").alias("found")
        )
        sinks.sink_source_health(found, health, self.store.path("health"))
        return health
