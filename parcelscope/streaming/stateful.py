"""Event rules with state: each visitor's or prospect's state lives in the state store (RocksDB).

Rules that depend on the order of events wait until the watermark has passed a row, and judge it
then, with all earlier rows known; so late rows within the watermark give what the batch rule gives.
A timer at the first waiting row wakes its key, and another one clears what can no longer change a verdict.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MICROS = 1_000_000
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, as the processors here need; the session's
    own setting is put back."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before is not None else spark.conf.unset(STORE)


class _InOrder(StatefulProcessor):
    """Holds the rows (key, us, id) of a shard until the watermark has passed them, then judges them in order.

    A shard holds many keys, as each state and timer that is touched costs a call: calls grow with the shards and
    the batches, not with the keys. Its rows are held as arrays, an entry for each batch. `done` rows are judged
    and stay as long as they can change a verdict; they are earlier than all others of their key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "key array<string>, us array<bigint>, id array<bigint>, done array<boolean>")

    def judged(self, rows: pd.DataFrame, watermark_us: int) -> tuple[pd.DataFrame, pd.DataFrame, int | None]:
        """(output, rows to remember, when the first of those can go) of rows in order of key and time."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            us = batch["us"].tolist()
            self.held.appendValue((batch["key"].tolist(), us, batch["id"].tolist(), [False] * len(us)))
            first = min(us) if first is None else min(first, *us)
        # the watermark may be beyond some of them already; the timer then fires in the next batch
        self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        entries = list(self.held.get()) if self.held.exists() else []
        every = pd.DataFrame({c: [x for e in entries for x in e[i]] for i, c in enumerate(["key", "us", "id", "done"])})
        every = every.astype({"us": "int64", "id": "int64", "done": "bool"})
        late = every["us"] >= watermark
        rest, settled = every[late], every[~late].sort_values(["key", "us", "id"], ignore_index=True)
        out, kept, until = self.judged(settled, watermark)
        left = pd.concat([kept.assign(done=True), rest])
        if len(left):
            self.held.put([tuple(left[c].tolist() for c in every.columns)])
            times = [rest["us"].min()] if len(rest) else []
            self.handle.registerTimer(int(min(times + ([until] if len(kept) else []))) // 1000 + 1)
        elif entries:
            self.held.clear()
        # columns of plain Python values become Arrow arrays of one piece, as Spark's writer expects
        yield pd.DataFrame({c: pd.Series(out[c].tolist(), dtype=object) for c in out.columns})

    def close(self) -> None:
        pass


class RateLimit(_InOrder):
    """A hit is limited if the hit of its key n places before it lies within the window; rejected hits count
    too. So the last n hits of a key are remembered, until the window has passed."""

    def __init__(self, n: int, secs: int):
        self.n, self.width = n, secs * MICROS

    def judged(self, rows, watermark_us):
        before = rows.groupby("key", sort=False)["us"].shift(self.n, fill_value=-(1 << 62))
        out = rows.assign(limited=before > rows["us"] - self.width)[~rows["done"]][["key", "id", "limited"]]
        last = rows.groupby("key", sort=False).tail(self.n) if self.n else rows[:0]
        kept = last[last["us"] + self.width >= watermark_us]
        return out, kept, kept["us"].min() + self.width


class DedupeOpens(_InOrder):
    """The last open of a key that was kept is remembered until the gap has passed.

    (A time to live would do the same by the clock on the wall; but with one, Spark never ends a run that is to
    stop when nothing is left, and a replay of old files would keep all state.)"""

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def judged(self, rows, watermark_us):
        held, last, chosen = None, 0, []
        for i, (key, us) in enumerate(zip(rows["key"].tolist(), rows["us"].tolist())):
            if key != held or us - last >= self.gap:
                held, last = key, us
                chosen.append(i)
        found = rows.iloc[chosen]
        newest = found.groupby("key", sort=False).tail(1)
        kept = newest[newest["us"] + self.gap >= watermark_us]
        return found[~found["done"]][["key", "id"]], kept, kept["us"].min() + self.gap


def _status_step(key, rows, state: GroupState) -> Iterator[pd.DataFrame]:
    """State: the stored status, whether a stop and a reply were seen, and the earliest moving event.

    These do not depend on the order of arrival. One row per micro-batch with events of the prospect.
    """
    start, stopped, replied, us, event_id, first = state.get if state.exists else (None, False, False, None, None, None)
    for batch in rows:
        for s, u, i, e in zip(batch["start"], batch["us"].tolist(), batch["id"].tolist(), batch["event"]):
            start = start or s or "new"
            stopped, replied = stopped or e == "stop", replied or e == "replied"
            if e in ("sent", "replied", "trial") and (us is None or (u, i) < (us, event_id)):
                us, event_id, first = u, i, e
    state.update((start, stopped, replied, us, event_id, first))
    if stopped or start == "stop":
        status = "stop"
    elif start in ("trial", "paid"):
        status = start
    elif start == "new" and first == "trial":
        status = "trial"
    elif replied:
        status = "replied"
    else:
        status = first if start == "new" and first else start
    yield pd.DataFrame({"prospect_id": [key[0]], "status": [status]})


SHARDS = 512


def _sharded(rows: DataFrame, keys: list[str], shards: int):
    """Rows as (shard, key, us, id), grouped by shard. A key travels as JSON, so any types and nulls do. The
    number of shards bounds the calls; a checkpoint keeps the one it began with."""
    text = F.to_json(F.struct(*keys))
    return rows.select(
        F.pmod(F.xxhash64(text), F.lit(shards)).alias("shard"), text.alias("key"), F.unix_micros("created_at").alias("us"), "id", "created_at",
    ).groupBy("shard")


def _own_keys(out: DataFrame, events: DataFrame, keys: list[str], *others: str) -> DataFrame:
    types = dict(events.dtypes)
    return out.withColumn("key", F.from_json("key", ", ".join(f"{k} {types[k]}" for k in keys))).select("key.*", *others)


def rate_limit_stream(
    events: DataFrame, n: int = 120, secs: int = 60, late: str = "1 hour", shards: int = SHARDS
) -> DataFrame:
    """(vid, id, limited) of a stream of page events. Start its query inside `rocksdb`."""
    rows = events.withWatermark("created_at", late)
    out = _sharded(rows, ["vid"], shards).transformWithStateInPandas(
        RateLimit(n, secs), "key string, id bigint, limited boolean", "append", "EventTime")
    return _own_keys(out, events, ["vid"], "id", "limited")


def dedupe_opens_stream(events: DataFrame, hours: int = 1, late: str = "1 hour", shards: int = SHARDS) -> DataFrame:
    """(prospect_id, campaign_id, id) of the opens that are kept. Start its query inside `rocksdb`."""
    opened = events.withWatermark("created_at", late).where(F.col("event") == "opened")
    keys = ["prospect_id", "campaign_id"]
    out = _sharded(opened, keys, shards).transformWithStateInPandas(
        DedupeOpens(hours * 3600 * MICROS), "key string, id bigint", "append", "EventTime")
    return _own_keys(out, events, keys, "id")


def prospect_status_stream(events: DataFrame, prospects: DataFrame | None = None) -> DataFrame:
    """(prospect_id, status) whenever a prospect has new events. A prospect starts from its stored
    status (`prospects`, a static table), as in the batch rule, else from "new".

    There is one small state per prospect, kept for good: its status never loses its meaning.
    """
    rows = events.where(F.col("prospect_id").isNotNull()).select(
        "prospect_id", "id", "event", F.unix_micros("created_at").alias("us")
    )
    if prospects is None:
        rows = rows.withColumn("start", F.lit(None).cast("string"))
    else:
        stored = prospects.select(F.col("id").alias("prospect_id"), F.col("status").alias("start"))
        rows = rows.join(stored, "prospect_id", "left")
    return rows.groupBy("prospect_id").applyInPandasWithState(
        _status_step, "prospect_id bigint, status string",
        "start string, stopped boolean, replied boolean, us bigint, id bigint, first string", "update",
        GroupStateTimeout.NoTimeout,
    )
