"""Streams as registered queries: a table is landed in files, read as a stream until nothing is left
(`availableNow`), and what the stream wrote is read back. Each has the result of a batch rule."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import report as R
from ..schemas import SIGNAL_RECORD
from ..session import cut_lineage, shared_folder
from ..streaming import ingest, stateful
from . import queries_outreach, queries_report, queries_resolve  # noqa: F401  their SQL is shared
from .oracle_tables import AS_OF, TODAY
from .registry import SQL, Tables, query


def _folder(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def _landed(t: Tables, name: str, parts: list[DataFrame]) -> tuple[str, DataFrame]:
    """(folder, stream): the parts as files that arrive one after the other, one in each micro-batch."""
    folder = _folder(t, name)
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(folder)
    schema = parts[0].schema
    return folder, t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _finished(t: Tables, writer, folder: str) -> None:
    with stateful.rocksdb(t.spark):
        run = writer.option("checkpointLocation", f"{folder}-checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()


def _written(t: Tables, stream: DataFrame, name: str) -> DataFrame:
    """The rows that a stream appends to files."""
    folder = _folder(t, name)
    _finished(t, stream.writeStream.format("parquet").option("path", folder), folder)
    return t.spark.read.schema(stream.schema).parquet(folder)


# --- arrival windows with late rows ----------------------------------------------------------------
# Rows arrive in order of time, but for every fiftieth, which arrives at the end. Those whose window the
# watermark (a day behind) has passed by then are late; Spark takes the one that the batch before began with.

_LATE = """external_id::BIGINT % 50 = 0 AND created_at::DATE + 1 <=
    (SELECT max(created_at) - INTERVAL 1 DAY FROM signals
      WHERE external_id::BIGINT % 50 <> 0 AND created_at <= TIMESTAMP '2024-01-21')"""


@query("signal_counts_stream", f"""
  SELECT created_at::DATE::TIMESTAMP AS window_start, (created_at::DATE + 1)::TIMESTAMP AS window_end, signal_type,
    count_if(NOT ({_LATE})) AS n, count_if({_LATE}) AS n_late
  FROM signals GROUP BY ALL""")
def _(t: Tables):
    rows = t.signals.select("external_id", "signal_type", "created_at")
    behind = F.col("external_id").cast("bigint") % 50 == 0
    days = [F.col("created_at") < "2024-01-11", F.col("created_at").between("2024-01-11", "2024-01-21"), F.col("created_at") > "2024-01-21"]
    _, stream = _landed(t, "signals", [*(rows.where(~behind & d) for d in days), rows.where(behind)])
    counts, late, marks = _folder(t, "counts"), _folder(t, "late"), _folder(t, "marks")

    def updated(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{counts}/batch={number}")

    def aside(batch: DataFrame, number: int) -> None:
        """Rows whose window had passed the watermark with which the batch before began."""
        spark = batch.sparkSession
        batch.agg(F.max("created_at").alias("newest")).write.mode("overwrite").parquet(f"{marks}/batch={number}")
        mark = spark.read.parquet(marks).where(F.col("batch") < number - 1).agg(F.max("newest") - F.expr("interval 1 day"))
        end = F.window("created_at", "1 day")["end"]
        batch.join(mark.toDF("mark")).where(end <= F.col("mark")).drop("mark").write.mode("overwrite").parquet(f"{late}/batch={number}")

    windows = E.signal_counts_windowed(stream, "1 day", watermark="1 day")
    _finished(t, windows.writeStream.outputMode("update").foreachBatch(updated), counts)
    _finished(t, stream.writeStream.foreachBatch(aside), late)
    key = ["window_start", "window_end", "signal_type"]
    on_time = t.spark.read.parquet(counts).groupBy(*key).agg(F.max_by("n", "batch").alias("n"))
    aside_rows = t.spark.read.schema(rows.schema).parquet(f"{late}/batch=*")
    dropped = E.signal_counts_windowed(aside_rows, "1 day").withColumnRenamed("n", "n_late")
    none = F.lit(0).cast("bigint")
    return on_time.join(dropped, key, "full_outer").select(*key, F.coalesce("n", none).alias("n"), F.coalesce("n_late", none).alias("n_late"))


@query("fresh_vs_backfill_stream", SQL["fresh_vs_backfill"])
def _(t: Tables):
    rows = t.signals.select("source", "external_id", "event_date", "created_at")
    early = F.col("created_at") < "2024-01-16"
    _, stream = _landed(t, "filings", [rows.where(early), rows.where(~early)])
    return _written(t, R.fresh_vs_backfill(stream, t.as_of).select("source", "external_id", "filing"), "labelled")


# --- rules with state --------------------------------------------------------------------------------
# Two rows far in the future move the watermark beyond all others.


def _with_clock(rows: DataFrame, key: dict) -> list[DataFrame]:
    """Rows in two files that overlap by less than an hour of event time, and the clock."""
    middle = F.lit("2024-01-16").cast("timestamp")
    second = (F.col("created_at") >= middle) | ((F.col("created_at") > middle - F.expr("interval 30 minutes")) & (F.col("id") % 3 == 0))
    tick = lambda day: rows.limit(1).select(*[
        (F.lit(day).cast("timestamp") if c == "created_at" else F.lit(-1) if c == "id" else F.lit(key.get(c))).cast(kind).alias(c)
        for c, kind in rows.dtypes])
    return [rows.where(~second), rows.where(second), tick("2034-01-01"), tick("2034-02-01")]


@query("rate_limit_stream", f"""
  SELECT id, vid, hits > 3 AS limited FROM ({queries_outreach._LIMITED.format(secs=86400)})""")
def _(t: Tables):
    rows = queries_outreach._pages(t).select("id", "vid", "created_at")
    _, stream = _landed(t, "pages", _with_clock(rows, {"vid": "clock"}))
    return _written(t, stateful.rate_limit_stream(stream, n=3, secs=86400), "limited").where("id >= 0").select("id", "vid", "limited")


@query("dedupe_opens_stream", f"SELECT id FROM ({queries_outreach._dedupe_sql(1)})")
def _(t: Tables):
    rows = t.outreach_events.select("id", "prospect_id", "campaign_id", "event", "created_at")
    _, stream = _landed(t, "opens", _with_clock(rows, {"event": "opened"}))
    return _written(t, stateful.dedupe_opens_stream(stream), "kept").where("id >= 0").select("id")


# --- the merging stream --------------------------------------------------------------------------------

_FIRST = "2024-01-25 00:00:00"


@query("incremental_signals", f"""
  SELECT s.source, s.external_id, coalesce(b.apn, o.apn) AS apn,
    CASE WHEN o.source IS NOT NULL THEN o.signal_type ELSE 'other' END AS signal_type,
    CASE WHEN b.source IS NOT NULL THEN b.status ELSE o.status END AS status,
    s.event_date, CASE WHEN o.source IS NOT NULL THEN TIMESTAMP '{_FIRST}' ELSE {AS_OF} END AS created_at,
    CASE WHEN b.source IS NOT NULL THEN {AS_OF} ELSE TIMESTAMP '{_FIRST}' END AS updated_at,
    CASE WHEN o.source IS NOT NULL THEN DATE '{_FIRST[:10]}' ELSE {TODAY} END AS observed_date
  FROM signals s
  LEFT JOIN (SELECT * FROM signals WHERE created_at < TIMESTAMP '2024-01-25') o
    ON o.source = s.source AND o.external_id = s.external_id
  LEFT JOIN {queries_resolve._MERGE_BATCH} b ON b.source = s.source AND b.external_id = s.external_id""")
def _(t: Tables):
    """Two waves of files, each merged into the store by its own run of the stream; then the second
    wave's batch once more, as after a failure between the merge and its checkpoint."""
    columns = [c.strip().split(" ")[0] for c in SIGNAL_RECORD.split(",")]
    first = queries_resolve._stored(t).withColumn("seq", F.col("external_id").cast("bigint")).select(*columns, "seq")
    second = cut_lineage(queries_resolve._batch(t).select(*columns, "seq"), "wave")  # landed, and merged again
    landing, store = _folder(t, "landing"), _folder(t, "store")
    for wave, as_of in ((first, _FIRST), (second, t.as_of)):
        wave.write.mode("append").parquet(landing)
        ingest.incremental_signals(t.spark, landing, store, f"{store}-checkpoint", as_of).awaitTermination()
    ingest.merge_into_store(store, t.as_of)(second, 1)
    return ingest.read_snapshot(t.spark, store).select(
        "source", "external_id", "apn", "signal_type", "status", "event_date", "created_at", "updated_at", "observed_date")


@query("signals_since", """
  SELECT source, external_id, created_at FROM signals WHERE created_at > TIMESTAMP '2024-01-28 12:00:00'""")
def _(t: Tables):
    return ingest.new_since(t.signals, "2024-01-28 12:00:00").select("source", "external_id", "created_at")
