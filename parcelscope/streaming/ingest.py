"""Incremental ingest: landed record files into signal snapshots, each file once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import dates as D
from ..operators.merge import change_set, merge_signals
from ..schemas import SIGNAL_RECORD, SIGNALS


def read_records(spark: SparkSession, landing: str) -> DataFrame:
    """The stream of landed record files, in the record layout plus the ingest sequence."""
    return spark.readStream.schema(SIGNAL_RECORD + ", seq bigint").parquet(landing)


# A store holds its rows in `data/bucket=B/version=V` and, for every batch, the version of each bucket in
# `pointers/batch=N`. A batch rewrites only the buckets of its own keys.
BUCKETS = 64
POINTER = "bucket int, version bigint"


def _bucket(buckets: int, keys: tuple[str, ...] = ("source", "external_id")) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _pointers(spark: SparkSession, store: str, before: int | None = None) -> tuple[int | None, dict[int, int]]:
    """(newest batch, version of each bucket): at most as many rows as there are buckets are collected."""
    try:
        every = spark.read.schema(POINTER + ", batch bigint").parquet(f"{store}/pointers")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None, {}  # nothing stored yet
    if before is not None:
        every = every.where(F.col("batch") < before)
    newest = every.agg(F.max("batch").alias("b")).first()["b"]
    return newest, {r["bucket"]: r["version"] for r in every.where(F.col("batch") == newest).collect()} if newest is not None else {}


def _read(spark: SparkSession, store: str, versions: dict[int, int], schema: str = SIGNALS) -> DataFrame:
    if not versions:
        # Known to be empty when planned, so that nothing is sorted or joined for it (rows from Python are not).
        return spark.range(1).select(F.from_json(F.lit(None).cast("string"), schema).alias("r")).select("r.*").limit(0)
    return spark.read.schema(schema).parquet(
        *[f"{store}/data/bucket={b}/version={v}" for b, v in sorted(versions.items())])


def read_snapshot(spark: SparkSession, store: str, before: int | None = None, schema: str = SIGNALS) -> DataFrame:
    """The newest snapshot, or the newest one older than a batch."""
    return _read(spark, store, _pointers(spark, store, before)[1], schema)


def bucket_versions(spark: SparkSession, store: str) -> dict[int, int]:
    """The batch that last wrote each bucket."""
    return _pointers(spark, store)[1]


def merge_into_store(store: str, as_of, buckets: int = BUCKETS):
    """A foreachBatch function that merges a micro-batch into the store.

    Only the buckets with keys of the batch are read and written. A repeated batch id writes its own
    version again, from the snapshot before it, so a restarted query does not apply a batch twice. One
    query writes to a store at a time; readers see a batch when its pointers are written, last.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _, versions = _pointers(spark, store, before=batch_id)
        touched = {r["b"] for r in batch.select(_bucket(buckets).alias("b")).distinct().collect()}
        current = _read(spark, store, {b: v for b, v in versions.items() if b in touched})
        merged, _ = merge_signals(current, batch, as_of)
        (merged.withColumns({"bucket": _bucket(buckets), "version": F.lit(batch_id).cast("bigint")})
         .repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket", "version").parquet(f"{store}/data"))
        now = {**versions, **dict.fromkeys(touched, batch_id)}
        spark.createDataFrame(sorted(now.items()), POINTER).coalesce(1).write.mode("overwrite").parquet(
            f"{store}/pointers/batch={batch_id}")

    return write


def merge_changes_into_store(
    store: str, schema: str, keys: tuple[str, ...], merge: Callable[[DataFrame, DataFrame], DataFrame],
    ignore: tuple[str, ...] = ("updated_at",), buckets: int = BUCKETS,
):
    """A foreachBatch function for tables that are delivered whole, though little of them changes.

    `merge` makes a new snapshot of the stored rows and a batch. Of it only rows that differ in a column
    that isn't ignored count as changed (found by row hash); buckets without such a row are not written, and
    a row that didn't change keeps its old values, `updated_at` among them. A batch that brings nothing
    new writes one small pointer file. What was said of batches above holds here too.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _, versions = _pointers(spark, store, before=batch_id)
        touched = {r["b"] for r in batch.select(_bucket(buckets, keys).alias("b")).distinct().collect()}
        current = _read(spark, store, {b: v for b, v in versions.items() if b in touched}, schema)
        changed = change_set(current, merge(current, batch).select(*current.columns), list(keys), ignore)
        changes = f"{store}/changes/batch={batch_id}"
        changed.write.mode("overwrite").parquet(changes)
        changed = spark.read.schema(current.schema).parquet(changes)
        differing = {r["b"] for r in changed.select(_bucket(buckets, keys).alias("b")).distinct().collect()}
        if differing:
            kept = _read(spark, store, {b: v for b, v in versions.items() if b in differing}, schema)
            rows = kept.join(changed.select(*keys), list(keys), "left_anti").select(*current.columns).unionByName(changed)
            (rows.withColumns({"bucket": _bucket(buckets, keys), "version": F.lit(batch_id).cast("bigint")})
             .repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("bucket", "version").parquet(f"{store}/data"))
        now = {**versions, **dict.fromkeys(differing, batch_id)}
        spark.createDataFrame(sorted(now.items()), POINTER).coalesce(1).write.mode("overwrite").parquet(
            f"{store}/pointers/batch={batch_id}")

    return write


def remove_old_versions(spark: SparkSession, store: str, keep: int = 2) -> int:
    """Delete the bucket versions that none of the newest `keep` batches points to; how many."""
    every = spark.read.schema(POINTER + ", batch bigint").parquet(f"{store}/pointers")
    batches = [r["batch"] for r in every.select("batch").distinct().orderBy(F.col("batch").desc()).limit(keep).collect()]
    used = {(r["bucket"], r["version"]) for r in every.where(F.col("batch").isin(batches)).select(
        "bucket", "version").distinct().collect()}
    old = {(r["bucket"], r["version"]) for r in every.select("bucket", "version").distinct().collect()} - used
    path = spark._jvm.org.apache.hadoop.fs.Path
    for b, v in old:
        folder = path(f"{store}/data/bucket={b}/version={v}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(old)


def incremental_signals(
    spark: SparkSession, landing: str, store: str, checkpoint: str, as_of
) -> StreamingQuery:
    """Merge every file that has landed since the last run, then stop."""
    return (
        read_records(spark, landing).writeStream
        .foreachBatch(merge_into_store(store, as_of))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def new_since(signals: DataFrame, high_water) -> DataFrame:
    """Batch twin: rows that arrived or changed after a high-water mark."""
    return signals.where(F.greatest("created_at", "updated_at") > D.as_of_col(high_water))
