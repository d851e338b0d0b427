"""Streams give what the batch jobs give over the same rows."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from parcelscope.operators import events as E
from parcelscope.operators import report as R
from parcelscope.streaming import ingest, stateful

BASE = dt.datetime(2026, 1, 1)
EVENT = "id bigint, vid string, prospect_id bigint, campaign_id bigint, event string, path string, created_at timestamp"


def rows(seed=5, n=300, span=20_000):
    rnd = random.Random(seed)
    out = []
    for i, s in enumerate(sorted(rnd.randrange(span) for _ in range(n))):
        out.append((i, f"v{rnd.choice([1, 1, 2])}", rnd.choice([1, 1, 2, 3]), rnd.choice([1, 2]),
                    rnd.choice(["opened", "sent", "replied", "trial", "clicked"]), "/report",
                    BASE + dt.timedelta(seconds=s)))
    return out


def stream_of(spark, tmp_path, data, files=2, settle=False):
    """Landed files read one per micro-batch, oldest first; `settle`: rows that move the watermark on."""
    src = tmp_path / "src"
    if settle:  # two more batches, far enough apart that the second one judges all before it
        size = -(-len(data) // files)
        later = [(-1 - k, "clock", None, None, "opened", "/", BASE + dt.timedelta(days=30 + k)) for k in range(2)]
        data = [*data, *[None] * (size * files - len(data))]
        data, files = [*data, later[0], *[None] * (size - 1), later[1]], files + 2
        for i in range(files):
            part = [r for r in data[i * size:(i + 1) * size] if r]
            spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(str(src))
        return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(src))
    size = -(-len(data) // files)
    for i in range(files):
        part = spark.createDataFrame(data[i * size:(i + 1) * size], EVENT)
        part.coalesce(1).write.mode("append").parquet(str(src))
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(src))


def drain(df, tmp_path, name, mode="append"):
    spark = df.sparkSession
    with stateful.rocksdb(spark):
        q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
             .option("checkpointLocation", str(tmp_path / f"ck_{name}")).trigger(availableNow=True).start())
        q.awaitTermination(180)
    assert q.exception() is None
    return spark.table(name)


def shuffled(data, seconds=1500):
    """The rows in an order of arrival that is late by up to `seconds`."""
    rnd = random.Random(9)
    return sorted(data, key=lambda r: r[-1] + dt.timedelta(seconds=rnd.randrange(seconds)))


def test_rate_limit_stream(spark, tmp_path):
    data = shuffled(rows())
    stream = stream_of(spark, tmp_path, data, 4, settle=True)
    got = drain(stateful.rate_limit_stream(stream, n=3, secs=600), tmp_path, "limited").where("id >= 0")
    want = E.rate_limit(spark.createDataFrame(data, EVENT), n=3, secs=600)
    as_set = lambda d: {(r["vid"], r["id"], r["limited"]) for r in d.select("vid", "id", "limited").collect()}
    assert as_set(got) == as_set(want) and any(x[2] for x in as_set(want))


def test_dedupe_opens_stream(spark, tmp_path):
    data = shuffled(rows())
    stream = stream_of(spark, tmp_path, data, 4, settle=True)
    got = drain(stateful.dedupe_opens_stream(stream), tmp_path, "opens").where("id >= 0")
    want = E.dedupe_opens(spark.createDataFrame(data, EVENT))
    assert {r["id"] for r in got.collect()} == {r["id"] for r in want.collect()}


def test_status_stream(spark, tmp_path):
    data = shuffled(rows())
    stored = spark.createDataFrame([(1, "new"), (2, "paid"), (3, None)], "id bigint, status string")
    got = drain(stateful.prospect_status_stream(stream_of(spark, tmp_path, data, 4), stored), tmp_path, "status", "update")
    final = {}
    for r in got.collect():  # the memory sink keeps the batches in order
        final[r["prospect_id"]] = r["status"]
    want = {r["prospect_id"]: r["status"] for r in E.prospect_status_fold(spark.createDataFrame(data, EVENT), stored).collect()}
    assert final == want


def test_stateless_and_windowed_streams(spark, tmp_path):
    data = rows()
    stream = stream_of(spark, tmp_path, data)
    extra = {"session_id": F.lit("s"), "meta": F.lit("{}"), "ms": F.lit(1.0)}
    cleaned = drain(E.clean_page_events(stream.withColumns(extra)), tmp_path, "cleaned")
    assert cleaned.count() == len(data)
    typed = stream.withColumn("signal_type", F.col("event"))
    counts = drain(E.signal_counts_windowed(typed, "1 hour", watermark="1 hour"), tmp_path, "counts", "complete")
    want = E.signal_counts_windowed(spark.createDataFrame(data, EVENT).withColumn("signal_type", F.col("event")), "1 hour")
    assert sorted(map(str, counts.collect())) == sorted(map(str, want.collect()))
    dated = stream.withColumn("event_date", F.to_date("created_at"))
    labelled = drain(R.fresh_vs_backfill(dated, "2026-01-10 00:00:00"), tmp_path, "labelled")
    assert {r["filing"] for r in labelled.select("filing").distinct().collect()} == {"fresh"}


def test_incremental_ingest_reads_each_file_once(spark, tmp_path):
    landing, store, ck = (str(tmp_path / d) for d in ("landing", "store", "ck"))

    def land(rows_):
        from parcelscope.schemas import SIGNAL_RECORD
        data = [("probate", "court_probate", i, apn, None, dt.date(2026, 1, 1), status, "A B", None, "{}", seq)
                for i, apn, status, seq in rows_]
        spark.createDataFrame(data, SIGNAL_RECORD + ", seq bigint").coalesce(1).write.mode("append").parquet(landing)

    def run(as_of):
        ingest.incremental_signals(spark, landing, store, ck, as_of).awaitTermination(120)
        return {r["external_id"]: r for r in ingest.read_snapshot(spark, store).collect()}

    land([("1", "9", "open", 1), ("2", None, "open", 2), ("2", None, "late", 3)])
    first = run("2026-01-05 00:00:00")
    assert sorted(first) == ["1", "2"] and first["2"]["status"] == "late"
    land([("1", None, "closed", 4), ("3", None, "open", 5)])
    second = run("2026-01-06 00:00:00")
    assert sorted(second) == ["1", "2", "3"]
    assert (second["1"]["apn"], second["1"]["status"]) == ("9", "closed")
    assert second["1"]["created_at"] == first["1"]["created_at"]
    assert second["2"]["updated_at"] == first["2"]["updated_at"]
    assert run("2026-01-07 00:00:00").keys() == second.keys()  # nothing new landed


def test_a_batch_rewrites_its_own_buckets(spark, tmp_path):
    from parcelscope.schemas import SIGNAL_RECORD

    def batch(ids, status):
        data = [("probate", "court_probate", str(i), None, None, dt.date(2026, 1, 1), status, "A B", None, "{}", i) for i in ids]
        return spark.createDataFrame(data, SIGNAL_RECORD + ", seq bigint")

    store = str(tmp_path / "store")
    merge = ingest.merge_into_store(store, "2026-01-05 00:00:00", buckets=8)
    merge(batch(range(40), "open"), 0)
    merge(batch([3], "closed"), 1)
    merge(batch([3], "closed"), 1)  # the same batch again
    versions = ingest._pointers(spark, store)[1]
    assert len(versions) == 8 and sorted(versions.values()) == [0] * 7 + [1]
    got = {r["external_id"]: r["status"] for r in ingest.read_snapshot(spark, store).collect()}
    assert len(got) == 40 and got["3"] == "closed" and got["4"] == "open"
    assert ingest.read_snapshot(spark, store, before=1).where("status = 'closed'").count() == 0
    merge(batch([3], "again"), 2)
    merge(batch([3], "more"), 3)
    assert ingest.remove_old_versions(spark, store) == 2  # the bucket's versions 0 and 1
    assert ingest.read_snapshot(spark, store).count() == 40 and ingest.read_snapshot(spark, store, before=3).count() == 40


@pytest.mark.parametrize("high,n", [("2026-01-01 00:00:00", 2), ("2026-01-03 00:00:00", 0)])
def test_new_since(spark, high, n):
    df = spark.sql("select timestamp'2026-01-01 00:00:00' created_at, timestamp'2026-01-02 00:00:00' updated_at "
                   "union all select timestamp'2026-01-02 00:00:00', timestamp'2026-01-02 00:00:00'")
    assert ingest.new_since(df, high).count() == n


@pytest.mark.parametrize("rule", ["limit", "opens"])
def test_ordered_rules_across_a_restart(spark, tmp_path, rule):
    """Late files, a stop in the middle, and state that goes when the time has passed it."""
    data = shuffled(rows(seed=6))
    clock = [[(-1 - k, "clock", 99, 1, "opened", "/", BASE + dt.timedelta(days=30 + k))] for k in range(2)]
    src, sink, ck = (str(tmp_path / d) for d in ("src", "sink", "ck"))
    rule_of = {"limit": lambda s: stateful.rate_limit_stream(s, n=3, secs=600), "opens": stateful.dedupe_opens_stream}[rule]

    def run(parts):
        for part in parts:
            spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(src)
        with stateful.rocksdb(spark):
            q = (rule_of(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", ck)
                 .trigger(availableNow=True).start())
            assert q.awaitTermination(240) and q.exception() is None
        return [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]

    held = run([data[:100], data[100:160]])
    held += run([data[160:], *clock])
    got = {tuple(r) for r in spark.read.parquet(sink).where("id >= 0").collect()}
    df = spark.createDataFrame(data, EVENT)
    if rule == "limit":
        want = {(r["vid"], r["id"], r["limited"]) for r in E.rate_limit(df, n=3, secs=600).collect()}
        assert any(x[2] for x in want)
    else:
        want = {(r["prospect_id"], r["campaign_id"], r["id"]) for r in E.dedupe_opens(df).collect()}
    assert got == want
    assert held[-1] <= 1 < max(held)  # what is left is the clock's own


def test_calls_grow_with_shards_not_with_keys(spark, tmp_path):
    """Thousands of keys, some without a prospect or a campaign, are a few states; results are the batch rule's."""
    rnd = random.Random(4)
    data = [(i, f"v{i % 1500}", rnd.choice([None, i % 1500]), rnd.choice([None, 1]), "opened", "/", BASE + dt.timedelta(seconds=3 * i))
            for i in range(6000)]
    clock = [(-1 - k, "clock", None, None, "opened", "/", BASE + dt.timedelta(days=30 + k)) for k in range(2)]
    src = str(tmp_path / "src")
    for part in (data[:3000], data[3000:], clock[:1], clock[1:]):
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(src)
    df = spark.createDataFrame(data, EVENT)
    with stateful.rocksdb(spark):
        q = (stateful.dedupe_opens_stream(stream, shards=4).writeStream.format("memory").queryName("sharded")
             .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
        assert q.awaitTermination(240) and q.exception() is None
    assert max(p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators) <= 2 * 4
    got = spark.table("sharded").where("id >= 0").collect()
    want = E.dedupe_opens(df).select("prospect_id", "campaign_id", "id").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and any(r["prospect_id"] is None for r in got)


def test_an_empty_store_is_known_to_be_empty(spark, tmp_path):
    empty = ingest.read_snapshot(spark, str(tmp_path / "none"))
    assert empty.schema == spark.createDataFrame([], ingest.SIGNALS).schema and empty.count() == 0
    assert empty._jdf.queryExecution().optimizedPlan().toString().startswith("LocalRelation <empty>")
