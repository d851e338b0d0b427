"""Tables bucketed by parcel number are joined and grouped where they lie."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from parcelscope.operators import layout as L
from parcelscope.operators import report as R
from parcelscope.operators import score as S

AS_OF = "2024-01-31 00:00:00"



@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(1)
    # every third signal is on one parcel, every tenth has none
    apn = lambda i: None if i % 10 == 0 else "7" if i % 3 == 0 else str(rnd.randrange(200))
    signals = spark.createDataFrame(
        [(rnd.choice(["probate", "lien", "trustee_sale"]), "s", str(i), apn(i), None, dt.date(2024, 1, 1 + i % 28), "A B",
          dt.datetime(2024, 1, 2 + i % 28)) for i in range(2000)],
        "signal_type string, source string, external_id string, apn string, source_url string, event_date date, owner_name string, created_at timestamp")
    properties = spark.createDataFrame(
        [(str(i), f"{i} ELM ST", "MESA", "85001", "SMITH JOHN", "1 OAK AVE, MESA, AZ, 85001", i % 2 == 0, dt.date(2010, 1, 1), 1e5, 2e5) for i in range(250)],
        "apn string, situs_address string, situs_city string, situs_zip string, owner_name string, mailing_address string, absentee boolean, "
        "last_sale_date date, last_sale_price double, assessed_value double")
    keyed, rest = L.by_parcel(signals, "signals", 4)
    return signals, properties, keyed, rest, L.bucketed(properties, "properties", buckets=4)


def plan(df):
    """The plan as it runs: joins are not left to broadcasts of these small tables."""
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        same = df.select("*")
        same.collect()
        return same._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def both(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_score_join_has_no_exchange(spark, tables):
    signals, properties, keyed, _, parcels = tables
    job = lambda s, p: S.score_join(S.type_signals_rollup(S.latest_per_type(s)), p)
    both(job(signals, properties), job(keyed, parcels))
    text = plan(job(keyed, parcels))
    assert text.count("Scan parquet") >= 2 and "Exchange" not in text
    assert "Exchange" in plan(job(signals, properties))


def test_semi_join_has_no_exchange(spark, tables):
    signals, _, keyed, _, _ = tables
    job = lambda s: R.apn_semi_reduce(s, R.distinct_apns(R.arrival_window(s, AS_OF, 240)))
    both(job(signals), job(keyed))
    assert "Exchange" not in plan(job(keyed))


def test_report_joins_have_no_exchange(spark, tables):
    signals, properties, keyed, rest, parcels = tables
    scores = spark.createDataFrame([(str(i), i % 90, i % 90 > 60) for i in range(250)], "apn string, score int, hot boolean")
    marks = L.bucketed(scores, "scores", buckets=4)

    def job(with_parcel, without, p, m, every):
        return R.report_enrich(R.dedupe_resolved(R.arrival_window(with_parcel, AS_OF, 720)),
                               R.dedupe_unresolved(R.arrival_window(without, AS_OF, 720)), every, p, m, AS_OF)

    both(job(signals, signals, properties, scores, signals), job(keyed, rest, parcels, marks, keyed))
    none = rest.where(F.lit(False))
    assert "Exchange hashpartitioning" not in plan(job(keyed, none, parcels, marks, keyed))


def test_report_sorts_no_history(spark, tables):
    """Signals are folded before they meet the report's rows, and buckets grow in number with the rows."""
    _, _, keyed, rest, parcels = tables
    scores = spark.createDataFrame([(str(i), i % 90, i % 90 > 60) for i in range(250)], "apn string, score int, hot boolean")
    marks = L.bucketed(scores, "scores", buckets=4)
    fresh = R.arrival_window(keyed, AS_OF, 720)
    both(R.dedupe_resolved(fresh), R.dedupe_resolved_in_buckets(fresh))
    assert "Exchange" not in plan(R.dedupe_resolved_in_buckets(fresh))
    gaps = [(a, d, c, e) for a in "12" for d in (None, dt.date(2024, 1, 3), dt.date(2024, 1, 4)) for c in (None, dt.datetime(2024, 1, 5)) for e in "xy"]
    rows = spark.createDataFrame([(*r[:3], "s", r[3]) for r in gaps], "apn string, event_date date, created_at timestamp, source string, external_id string")
    for some in (rows, rows.where("event_date is null"), rows.where("created_at is null")):
        both(R.dedupe_resolved(some), R.dedupe_resolved_in_buckets(some))
    text = plan(R.report_enrich(R.dedupe_resolved_in_buckets(fresh), R.dedupe_unresolved(R.arrival_window(rest, AS_OF, 720)),
                                keyed, parcels, marks, AS_OF))
    assert "LeftSemi" not in text
    assert L.buckets_for(100_000) == 8 and L.buckets_for(36_000_000) == 144
    files = {f.rsplit("/", 1)[-1].split("_")[-1].split(".")[0] for f in keyed.inputFiles()}
    assert len(files) == len(keyed.inputFiles()) <= 4
