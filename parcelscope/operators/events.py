"""Rules over event logs, as batch jobs. The streaming twins are in parcelscope.streaming.

A window over a time range never needs rows older than the range, so rows are partitioned by
(key, time bucket) and the bucket before is carried along: a key with very many events is spread
over its time line.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

MICROS = 1_000_000


def clean_page_events(raw: DataFrame) -> DataFrame:
    """Usable page events with bounded text. Stateless, for batch and stream."""
    path = F.substring(F.coalesce("path", F.lit("/")), 1, 300)
    event = F.substring(strip(F.coalesce("event", F.lit(""))), 1, 60)
    ms = F.col("ms").cast("double")
    finite = ~F.isnan(ms) & (F.abs(ms) < float("inf"))
    cleaned = raw.withColumns(
        {
            "path": path, "event": event, "session_id": F.substring("session_id", 1, 80),
            "meta": F.substring("meta", 1, 4000),
            "ms": F.when(finite, F.floor(ms + 0.5).cast("bigint")),
        }
    )
    return cleaned.where(~F.startswith("path", F.lit("/admin")) & (F.col("event") != ""))


def _with_previous_bucket(df: DataFrame, ts_us: Column, width_us: int) -> DataFrame:
    """Every row in its time bucket, and once more as context in the next one."""
    return df.withColumn("__us", ts_us).select(
        "*", F.explode(F.array(F.lit(0), F.lit(1))).alias("__ctx")
    ).withColumn("__bucket", F.floor(F.col("__us") / width_us) + F.col("__ctx"))


def rate_limit(
    events: DataFrame, n: int = 120, secs: int = 60, key: str = "vid", ts: str = "created_at",
    order: str = "id",
) -> DataFrame:
    """Events with `hits` (this visitor's events in the last secs, this one included) and `limited`.

    Rejected events count as hits too, so the rule needs no running state.
    """
    width = secs * MICROS
    spread = _with_previous_bucket(events, F.unix_micros(ts), width)
    part = Window.partitionBy(key, "__bucket")
    seen = F.row_number().over(part.orderBy("__us", order))
    expired = F.count("*").over(
        part.orderBy("__us").rangeBetween(Window.unboundedPreceding, -width)
    )
    return (
        spread.withColumn("hits", seen - expired)
        .where(F.col("__ctx") == 0)
        .withColumn("limited", F.col("hits") > n)
        .drop("__us", "__ctx", "__bucket")
    )


def click_after_send_asof(events: DataFrame, secs: int = 5, bucket_secs: int = 3600) -> DataFrame:
    """Clicks with `sent_at`, the prospect's latest send up to the click however old it is (NULL: none),
    and `too_soon`: less than `secs` after it.

    A prospect's time line is cut into buckets, which lie in different tasks. In a bucket the last send
    before a click is found in order of time. What earlier buckets leave behind is a running maximum over
    one row per bucket, so a prospect with very many events is one short row sequence there.
    """
    width = bucket_secs * MICROS
    click = F.col("event") == "clicked"
    both = events.where(F.col("event").isin("sent", "clicked") & F.col("prospect_id").isNotNull()).withColumn(
        "__us", F.unix_micros("created_at")).withColumn("__bucket", F.floor(F.col("__us") / width))
    key = ["prospect_id", "__bucket"]
    sent_us = F.when(~click, F.col("__us"))
    before = Window.partitionBy("prospect_id").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy(*key).agg(F.max(sent_us).alias("__last"), F.count_if(click).alias("__clicks")).select(
        *key, F.max("__last").over(before).alias("__carried"), "__clicks").where("__clicks > 0").drop("__clicks")
    upto = Window.partitionBy(*key).orderBy("__us", click.cast("int")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    clicks = both.withColumn("__own", F.max(sent_us).over(upto)).where(click)
    sent = F.coalesce("__own", "__carried")
    return clicks.join(carried, key).withColumns(
        {"sent_at": F.timestamp_micros(sent), "too_soon": F.coalesce(F.col("__us") - sent < secs * MICROS, F.lit(False))}
    ).drop("__us", "__bucket", "__own", "__carried")


OPEN_KEY = ["prospect_id", "campaign_id"]


def dedupe_opens(events: DataFrame, hours: int = 1) -> DataFrame:
    """'opened' events kept: the first of a group, then each one at least `hours` after the last kept.

    What is kept depends on what was kept before, so the times of a group are read in order. A task
    streams its groups sorted by time and remembers one time; a group of any length needs no array.
    An event at least `hours` after the one before it is always kept, so groups are first cut there,
    and the parts of a long group are read by different tasks.
    """
    gap = hours * 3600 * MICROS
    times = events.where(F.col("event") == "opened").groupBy(
        *OPEN_KEY, F.unix_micros("created_at").alias("us")
    ).agg(F.min("id").alias("id"))
    order = Window.partitionBy(*OPEN_KEY).orderBy("us")
    starts = F.when(F.coalesce(F.col("us") - F.lag("us").over(order) >= gap, F.lit(True)), F.col("us"))
    runs = times.withColumn("run", F.max(starts).over(order))
    key = [*OPEN_KEY, "run"]

    def keep(batches):
        held, last = None, 0
        for rows in batches:
            out = []
            columns = (rows[c].tolist() for c in (*key, "us", "id"))
            for *group, us, event in zip(*columns):
                if group != held or us - last >= gap:
                    held, last = group, us
                    out.append(event)
            yield pd.DataFrame({"id": pd.Series(out, dtype="int64")})

    whole = runs.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("")) for k in OPEN_KEY})
    kept = whole.repartition(*key).sortWithinPartitions(*key, "us").mapInPandas(keep, "id bigint")
    return events.join(kept, "id", "left_semi")


def prospect_status_fold(events: DataFrame, prospects: DataFrame | None = None) -> DataFrame:
    """Status of every prospect after its events.

    Rules: stop always wins; a reply counts unless the prospect is on trial or paid; sent and trial
    only move a new prospect. So the first of (sent, replied, trial) and the presence of a stop or
    a reply decide, which aggregates without ordering a prospect's whole history.
    """
    e = F.col("event")
    moving = e.isin("sent", "replied", "trial")
    order = F.struct("created_at", "id")
    folded = events.where(F.col("prospect_id").isNotNull()).groupBy("prospect_id").agg(
        F.max((e == "stop").cast("int")).alias("stopped"),
        F.max((e == "replied").cast("int")).alias("replied"),
        F.min_by(F.when(moving, e), F.when(moving, order)).alias("first"),
    )
    if prospects is not None:
        start = prospects.select(
            F.col("id").alias("prospect_id"), F.coalesce("status", F.lit("new")).alias("start")
        )
        folded = start.join(folded, "prospect_id", "left")
    else:
        folded = folded.withColumn("start", F.lit("new"))
    first, start_col = F.col("first"), F.col("start")
    status = (
        F.when((F.coalesce("stopped", F.lit(0)) == 1) | (start_col == "stop"), "stop")
        .when(start_col.isin("trial", "paid"), start_col)
        .when((start_col == "new") & (first == "trial"), "trial")
        .when(F.coalesce("replied", F.lit(0)) == 1, "replied")
        .when((start_col == "new") & first.isNotNull(), first)
        .otherwise(start_col)
    )
    return folded.select("prospect_id", status.alias("status"))


# Billing states and what they mean for access.
SUBSCRIPTION_STATES = {
    "active": "active", "trialing": "active", "past_due": "past_due", "incomplete": "past_due",
    "canceled": "canceled", "unpaid": "canceled", "incomplete_expired": "canceled",
}


def customer_status_fold(events: DataFrame) -> DataFrame:
    """Status of every customer after its billing events (customer_id, type, raw_status, ts, id).

    Events before the first checkout find no customer; a checkout makes it active, so the last
    meaningful event of a customer with a checkout decides. Unknown types and states are ignored.
    """
    kind = F.col("type")
    mapped = F.lit(None).cast("string")
    for raw, status in SUBSCRIPTION_STATES.items():
        mapped = F.when(F.col("raw_status") == raw, status).otherwise(mapped)
    status = (
        F.when(kind == "checkout.session.completed", "active")
        .when(kind == "customer.subscription.deleted", "canceled")
        .when(kind == "invoice.payment_failed", "past_due")
        .when(kind == "customer.subscription.updated", mapped)
    )
    bought = F.count_if(kind == "checkout.session.completed")
    return (
        events.withColumn("status", status)
        .where(F.col("status").isNotNull())
        .groupBy("customer_id")
        .agg(
            F.max_by("status", F.struct("ts", "id")).alias("status"), bought.alias("__bought"),
            F.max("ts").alias("updated_at"),
        )
        .where(F.col("__bought") > 0)
        .drop("__bought")
    )


def signal_counts_windowed(
    signals: DataFrame, width: str = "1 day", slide: str | None = None, watermark: str | None = None
) -> DataFrame:
    """New signals per type and arrival window, tumbling or sliding; for batch and stream."""
    rows = signals.withWatermark("created_at", watermark) if watermark else signals
    window = F.window("created_at", width, slide) if slide else F.window("created_at", width)
    return rows.groupBy(window.alias("w"), "signal_type").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        "signal_type", "n",
    )
