"""Upserts as snapshot rewrites: one row per key, old and new sides joined on that key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from .topk import first_rows

SIGNAL_KEY = ["source", "external_id"]


def last_per_key(batch: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Latest row of every key in a batch, by its ingest sequence."""
    return first_rows(batch, keys, [F.col(seq).desc()]).drop(seq)


def _full_join(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    old = old.select(F.struct(*old.columns).alias("old"), *keys).withColumn("__o", F.lit(True))
    new = new.select(F.struct(*new.columns).alias("new"), *keys).withColumn("__n", F.lit(True))
    return old.join(new, keys, "full_outer").select(
        *keys, "old", "new",
        F.col("__o").isNotNull().alias("in_old"), F.col("__n").isNotNull().alias("in_new"),
    )


def _pick(name: str, overwrite: bool, in_old_type: bool, in_new_type: bool) -> Column:
    old = F.col(f"old.{name}") if in_old_type else F.lit(None)
    new = F.col(f"new.{name}") if in_new_type else F.lit(None)
    if overwrite:
        return F.when(F.col("in_new"), new).otherwise(old)
    return F.when(F.col("in_old"), old).otherwise(new)


def upsert(
    existing: DataFrame, batch: DataFrame, keys: list[str], overwrite: list[str],
    computed: dict[str, Column] | None = None,
) -> DataFrame:
    """Full-outer merge. `overwrite` columns take the batch value, others keep the first write."""
    joined = _full_join(existing, batch, keys)
    computed = computed or {}
    columns = []
    for name in existing.columns:
        if name in keys:
            columns.append(F.col(name))
        elif name in computed:
            columns.append(computed[name].alias(name))
        else:
            columns.append(
                _pick(name, name in overwrite, True, name in batch.columns).alias(name)
            )
    return joined.select(*columns)


def merge_signals(
    existing: DataFrame, batch: DataFrame, as_of, seq: str = "seq"
) -> tuple[DataFrame, DataFrame]:
    """(new snapshot, metrics per source: found, inserted).

    A re-observed signal refreshes apn (kept when the new one is missing), status, event date, raw,
    owner and address; everything else keeps the value of the first write.
    """
    now = D.as_of_col(as_of)
    latest = last_per_key(batch, SIGNAL_KEY, seq)
    snapshot = upsert(
        existing, latest, SIGNAL_KEY,
        overwrite=["status", "event_date", "raw", "owner_name", "situs_address"],
        computed={
            "apn": F.coalesce("new.apn", "old.apn"),
            "created_at": F.when(F.col("in_old"), F.col("old.created_at")).otherwise(now),
            "updated_at": F.when(F.col("in_new"), now).otherwise(F.col("old.updated_at")),
            "resolved": F.coalesce("old.resolved", F.lit(False)),
            "observed_date": F.when(F.col("in_old"), F.col("old.observed_date")).otherwise(
                F.to_date(now)
            ),
        },
    )
    return snapshot, merge_metrics(existing, batch)


def merge_metrics(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """found = rows of the batch, inserted = keys not stored before, per source."""
    known = existing.select(*SIGNAL_KEY).distinct().withColumn("known", F.lit(True))
    per_key = batch.groupBy(*SIGNAL_KEY).agg(F.count("*").alias("rows"))
    return (
        per_key.join(known, SIGNAL_KEY, "left")
        .groupBy("source")
        .agg(
            F.sum("rows").alias("found"),
            F.count_if(F.col("known").isNull()).alias("inserted"),
        )
    )


def row_hash(columns: list[str], ignore: tuple[str, ...] = ("updated_at",)) -> Column:
    """A 64-bit hash of a row without the ignored columns; nulls count by their place."""
    kept = sorted(c for c in columns if c not in ignore)
    return F.xxhash64(*[c for name in kept for c in (F.col(name).isNull(), F.col(name))])


def change_set(existing: DataFrame, merged: DataFrame, keys: list[str], ignore: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """Rows of `merged` that `existing` hasn't, or has with other values in a column that isn't ignored.

    Only keys and hashes of the old side take part in the join."""
    old = existing.select(*keys, row_hash(existing.columns, ignore).alias("__old"))
    return merged.withColumn("__new", row_hash(merged.columns, ignore)).join(old, keys, "left").where(
        F.col("__old").isNull() | (F.col("__old") != F.col("__new"))).drop("__old", "__new")


def skip_already_stored(ids: DataFrame, signals: DataFrame, source: str) -> DataFrame:
    """Ids (column external_id) that the source has not stored yet."""
    stored = signals.where(F.col("source") == source).select("external_id")
    return ids.join(stored, "external_id", "left_anti")


def with_derived_columns(properties: DataFrame) -> DataFrame:
    """Columns computed from the owner name and the address, never stale."""
    return properties.withColumns(
        {
            "situs_norm": T.normalize_address("situs_address"),
            "owner_name_norm": T.normalize_owner_name("owner_name"),
            "owner_name_sorted": T.sorted_name_key("owner_name"),
        }
    )


def merge_properties(existing: DataFrame, batch: DataFrame, as_of, seq: str = "seq") -> DataFrame:
    latest = last_per_key(batch, ["apn"], seq)
    now = D.as_of_col(as_of)
    merged = upsert(
        existing, latest, ["apn"],
        overwrite=[c for c in existing.columns if c != "apn"],
        computed={
            "updated_at": F.when(F.col("in_new"), now).otherwise(F.col("old.updated_at"))
        } if "updated_at" in existing.columns else {},
    )
    return with_derived_columns(merged)


def merge_scores(existing: DataFrame, scored: DataFrame, as_of) -> DataFrame:
    """Fresh scores replace old ones; parcels not scored this time keep their row."""
    now = D.as_of_col(as_of)
    return upsert(
        existing, scored, ["apn"],
        overwrite=[c for c in existing.columns if c not in ("apn", "updated_at")],
        computed={
            "updated_at": F.when(F.col("in_new"), now).otherwise(F.col("old.updated_at"))
        },
    )


def recompute_absentee(properties: DataFrame, parcels: DataFrame) -> DataFrame:
    """Change set (apn, old, new) of parcels whose absentee flag differs."""
    fresh = parcels.select("apn", F.col("absentee").alias("new_absentee"))
    return (
        properties.select("apn", F.col("absentee").alias("old_absentee"))
        .join(fresh, "apn")
        .where(~F.col("old_absentee").eqNullSafe(F.col("new_absentee")))
    )


def absentee_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Absentee parcels before, after and the difference, in one pass over both snapshots."""
    sides = before.select("absentee", F.lit("before").alias("side")).unionByName(
        after.select("absentee", F.lit("after").alias("side"))
    )
    yes = F.coalesce(F.col("absentee"), F.lit(False))
    return sides.agg(
        F.count_if(yes & (F.col("side") == "before")).alias("n_before"),
        F.count_if(yes & (F.col("side") == "after")).alias("n_after"),
    ).withColumn("delta", F.col("n_after") - F.col("n_before"))


def backfill_situs_norm(properties: DataFrame) -> DataFrame:
    return properties.withColumn(
        "situs_norm", F.coalesce("situs_norm", T.normalize_address("situs_address"))
    )


def backfill_owner_sorted(properties: DataFrame) -> DataFrame:
    return properties.withColumn(
        "owner_name_sorted", F.coalesce("owner_name_sorted", T.sorted_name_key("owner_name"))
    )


def lead_actions_toggle(actions: DataFrame, log: DataFrame) -> DataFrame:
    """Apply an ordered log of (apn, action, on, seq) to the stored (apn, action) pairs.

    The last entry of a pair decides; pairs the log does not mention stay as they are.
    """
    last = log.groupBy("apn", "action").agg(F.max_by("on", "seq").alias("on"))
    untouched = actions.select("apn", "action").join(last, ["apn", "action"], "left_anti")
    return untouched.unionByName(last.where("on").select("apn", "action")).distinct()
