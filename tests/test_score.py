import datetime as dt

import pytest
from pyspark.sql import functions as F

from parcelscope.operators import score as S

NOW = "2026-01-01 00:00:00"


def day(days_ago):
    return dt.date(2026, 1, 1) - dt.timedelta(days=days_ago)


def scored(spark, signals, absentee=False, assessed=None, sale=dt.date(2025, 1, 1)):
    """signals: (type, days ago) of one parcel; no modifiers by default."""
    rows = [("1", t, day(d) if d is not None else None, dt.datetime(2025, 12, 31)) for t, d in signals]
    s = spark.createDataFrame(rows, "apn string, signal_type string, event_date date, created_at timestamp")
    p = spark.createDataFrame([("1", absentee, assessed, sale)],
                              "apn string, absentee boolean, assessed_value double, last_sale_date date")
    return S.score_parcels(s, p, NOW).first()


def test_half_life_and_age_limit(spark):
    df = spark.createDataFrame([(50, 0, 45), (50, 45, 45), (50, 90, 45), (50, 730, 365), (50, 731, 365), (50, None, 45)],
                               "b int, a bigint, h int")
    got = [round(r[0], 4) for r in df.select(S.decay_weight("b", "a", "h")).collect()]
    assert got == [50, 25, 12.5, 12.5, 0, 0]


@pytest.mark.parametrize("days_out,bonus,passed", [
    (15, 20, False), (0, 20, False), (30, 20, False), (31, 10, False), (45, 10, False), (60, 10, False),
    (61, 0, False), (-1, 0, True), (-30, 0, True)])
def test_auction_windows(spark, days_out, bonus, passed):
    notice = day(90 - days_out)
    a = spark.range(1).select(S.auction_info(F.lit(notice), NOW).alias("a")).first()["a"]
    assert (a["days_out"], a["bonus"], a["passed"]) == (days_out, bonus, passed)


def test_auction_day_is_passed_after_midnight(spark):
    a = spark.range(1).select(S.auction_info(F.lit(day(90)), "2026-01-01 00:00:01").alias("a")).first()["a"]
    assert a["days_out"] == -1 and a["passed"]


def test_single_fresh_signal(spark):
    r = scored(spark, [("probate", 0)])
    assert (r["score"], r["hot"]) == (45, False)  # 35 + fresh 10
    assert r["breakdown"]["fresh"] and r["breakdown"]["types"]["probate"]["live"]


def test_fresh_boundary(spark):
    assert scored(spark, [("tax_delinquent", 7)])["breakdown"]["fresh"]
    assert not scored(spark, [("tax_delinquent", 8)])["breakdown"]["fresh"]


def test_stack_bonus_counts_live_types_only(spark):
    live = scored(spark, [("probate", 20), ("tax_delinquent", 20)])
    assert live["hot"] and live["breakdown"]["live_count"] == 2
    one = scored(spark, [("probate", 700), ("tax_delinquent", 20)])  # probate decayed below a quarter
    assert not one["hot"] and one["breakdown"]["live_count"] == 1


def test_passed_auction_keeps_liveness_but_not_weight(spark):
    r = scored(spark, [("trustee_sale", 91)])
    t = r["breakdown"]["types"]["trustee_sale"]
    raw = 50 * 0.5 ** (91 / 45)
    assert r["breakdown"]["auction"]["passed"] and round(t["decayed"], 6) == round(raw * 0.25, 6)
    assert not t["live"]  # 91 days is past two half-lives


def test_modifiers(spark):
    r = scored(spark, [("lien", 20)], absentee=True, assessed=1.0, sale=None)
    plain = scored(spark, [("lien", 20)])
    assert r["score"] - plain["score"] == 25
    m = scored(spark, [("lien", 20)], assessed=1.0, sale=dt.date(2014, 1, 1))["breakdown"]["modifiers"]
    assert (m["high_equity"], m["long_tenure"]) == (True, False)


def test_unknown_type_is_never_live_but_counts_for_freshness(spark):
    r = scored(spark, [("martian", 1)])
    assert (r["score"], r["breakdown"]["live_count"]) == (10, 0)


def test_newest_date_per_type_and_arrival_fallback(spark):
    r = scored(spark, [("probate", 400), ("probate", 3), ("lien", None)])
    assert r["breakdown"]["types"]["probate"]["age_days"] == 3
    assert r["breakdown"]["types"]["lien"]["age_days"] == 1


def test_breakdown_v1(spark):
    r = scored(spark, [("trustee_sale", 1), ("lien", 1)], absentee=True)
    df = spark.createDataFrame([r])
    got = [(e["label"], e["points"]) for e in df.select(S.score_breakdown_v1("components")).first()[0]]
    assert got == [("Trustee Sale", 50), ("Signal stacking", 15), ("Absentee", 10), ("Fresh (last 30 days)", 10)]
