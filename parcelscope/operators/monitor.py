"""Run log: metrics, medians, volume drops, day status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import dates as D
from .topk import first_rows


def source_max_date(records: DataFrame) -> DataFrame:
    """Newest event date of each source in a batch."""
    return records.groupBy("source").agg(F.max("event_date").alias("source_max_date"))


def run_metrics(merge_metrics: DataFrame, records: DataFrame, as_of) -> DataFrame:
    """Run-log rows of a merged batch."""
    now = D.as_of_col(as_of)
    return merge_metrics.join(source_max_date(records), "source", "left").select(
        F.md5(F.concat_ws("|", "source", now.cast("string"))).alias("id"), "source",
        now.alias("started_at"), now.alias("finished_at"),
        F.col("found").cast("int").alias("rows_found"),
        F.col("inserted").cast("int").alias("rows_new"), F.lit("ok").alias("status"),
        F.lit(None).cast("string").alias("error"), "source_max_date",
    )


def recent_median(runs: DataFrame, before, limit: int = 14) -> DataFrame:
    """Median rows found over each source's last `limit` ok runs before an instant."""
    usable = runs.where(
        (F.col("status") == "ok") & F.col("rows_found").isNotNull()
        & (F.col("started_at") < D.as_of_col(before))
    )
    last = first_rows(usable, ["source"], [F.col("started_at").desc(), F.col("id")], limit)
    return last.groupBy("source").agg(F.median("rows_found").alias("median"))


def is_volume_drop(found: Column, median: Column) -> Column:
    collapse = (median >= 50) & (found < median * 0.1)
    return F.coalesce((median > 0) & ((found == 0) | collapse), F.lit(False))


def volume_drop(today: DataFrame, medians: DataFrame) -> DataFrame:
    """today: (source, status, found). Only ok rows are judged."""
    return (
        today.where(F.col("status") == "ok")
        .join(medians, "source", "left")
        .select(
            "source", "found", "median",
            is_volume_drop(F.col("found"), F.col("median")).alias("warn"),
            F.col("source").isin(K.CRITICAL_SOURCES).alias("critical"),
        )
    )


def mark_run_warn(runs: DataFrame, drops: DataFrame, day) -> DataFrame:
    """Turn the ok runs of a Phoenix day into warnings for the sources that dropped."""
    warned = drops.where("warn").select("source").distinct().withColumn("__w", F.lit(True))
    hit = (
        F.col("__w").isNotNull() & (F.col("status") == "ok")
        & (D.phoenix_date("started_at") == F.lit(str(day)).cast("date"))
    )
    return (
        runs.join(warned, "source", "left")
        .withColumn("status", F.when(hit, "warn").otherwise(F.col("status")))
        .select(*runs.columns)
    )


def pipeline_day_join(runs: DataFrame) -> DataFrame:
    """Runs of the Phoenix day of the newest run."""
    newest = runs.agg(D.phoenix_date(F.max("started_at"))).scalar()
    return runs.withColumn("day", D.phoenix_date("started_at")).where(F.col("day") == newest)


def pipeline_day_status(runs: DataFrame) -> DataFrame:
    """First start, last finish, sources and run counts by status of the newest day."""
    per_source = pipeline_day_join(runs).groupBy("day", "source").agg(
        F.min("started_at").alias("a"), F.max("finished_at").alias("b"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "warn", "error")],
    )
    listed = lambda s: F.array_sort(
        F.collect_set(F.when(F.col(s) > 0, F.col("source")))
    )
    return per_source.groupBy("day").agg(
        F.min("a").alias("started_at"), F.max("b").alias("finished_at"),
        F.count("*").alias("n_sources"),
        *[F.sum(s).alias(f"n_{s}") for s in ("ok", "warn", "error")],
        listed("warn").alias("warn_sources"), listed("error").alias("error_sources"),
    )


def runs_of_day(runs: DataFrame, as_of) -> DataFrame:
    bounds = D.phoenix_day_bounds(D.as_of_col(as_of))
    return runs.where(
        (F.col("started_at") >= bounds["start"]) & (F.col("started_at") < bounds["end"])
    )


def sources_complete_today(runs: DataFrame, sources: list[str], as_of) -> DataFrame:
    """One row: does every listed source have a finished, non-empty ok run this Phoenix day?"""
    done = runs_of_day(runs, as_of).where(
        F.col("source").isin(sources) & (F.col("status") == "ok") & (F.col("rows_found") > 0)
        & ~F.col("error").eqNullSafe("busy-stop")
    )
    n = F.count_distinct("source")
    return done.agg(n.alias("n_done"), (n == len(set(sources))).alias("complete"))


def todays_run(runs: DataFrame, source: str, as_of) -> DataFrame:
    """Newest ok or warn run of a source this Phoenix day (no row when there is none)."""
    return (
        runs_of_day(runs, as_of)
        .where((F.col("source") == source) & F.col("status").isin("ok", "warn"))
        .orderBy(F.col("started_at").desc(), "id").limit(1)
    )


def max_case_number(signals: DataFrame, source: str, year: int) -> DataFrame:
    """Highest n of the case numbers PEF{year}-{n} of a source, 0 when there are none."""
    n = F.regexp_extract("external_id", rf"^PEF{year}-(\d+)$", 1).try_cast("bigint")
    return signals.where(F.col("source") == source).agg(
        F.coalesce(F.max(n), F.lit(0).cast("bigint")).alias("max_n")
    )
