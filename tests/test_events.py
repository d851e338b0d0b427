import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from parcelscope.operators import events as E
from parcelscope.operators import outreach as O

BASE = dt.datetime(2026, 1, 1)
EVENT = "id bigint, prospect_id bigint, campaign_id bigint, variant string, event string, meta string, created_at timestamp"


def at(seconds):
    return BASE + dt.timedelta(seconds=seconds)


def opens(spark, rows):
    return spark.createDataFrame(
        [(i, p, 1, None, "opened", None, at(s)) for i, (p, s) in enumerate(rows)], EVENT)


def kept_by_hand(rows, gap=3600):
    last, out = {}, []
    for i, (p, s) in sorted(enumerate(rows), key=lambda r: (r[1][1], r[0])):
        if p not in last or s - last[p] >= gap:
            last[p] = s
            out.append(i)
    return sorted(out)


def test_dedupe_opens_counts_from_the_last_kept(spark):
    rows = [(1, 0), (1, 1800), (1, 3700), (1, 5000), (1, 3600 + 3700), (None, 10), (None, 20), (1, 0)]
    got = sorted(r["id"] for r in E.dedupe_opens(opens(spark, rows)).collect())
    assert got == kept_by_hand(rows) == [0, 2, 4, 5]


@pytest.mark.parametrize("seed,span", [(1, 40_000), (2, 400_000)])
def test_dedupe_opens_of_long_groups(spark, seed, span):
    rnd = random.Random(seed)
    rows = [(rnd.choice([1, 1, 1, 2, None]), rnd.randrange(span)) for _ in range(400)]
    df = opens(spark, rows)
    assert sorted(r["id"] for r in E.dedupe_opens(df).collect()) == kept_by_hand(rows)


def test_rate_limit_counts_rejected_hits_and_drops_old_ones(spark):
    rows = [(i, "v", at(s)) for i, s in enumerate([0, 0, 10, 59, 60, 61, 200])]
    df = spark.createDataFrame(rows, "id bigint, vid string, created_at timestamp")
    got = [(r["hits"], r["limited"]) for r in E.rate_limit(df, n=3, secs=60).orderBy("id").collect()]
    # At 60 s the two hits at 0 s are exactly 60 s old and gone.
    assert got == [(1, False), (2, False), (3, False), (4, True), (3, False), (4, True), (1, False)]


def test_click_after_send(spark):
    rows = [(1, 9, 1, None, "sent", None, at(0)), (2, 9, 1, None, "clicked", None, at(4)),
            (3, 9, 1, None, "clicked", None, at(5)), (4, 8, 1, None, "clicked", None, at(1)),
            (5, 9, 1, None, "sent", None, at(7)), (6, 9, 1, None, "clicked", None, at(7))]
    got = {r["id"]: r["too_soon"] for r in E.click_after_send_asof(spark.createDataFrame(rows, EVENT)).collect()}
    assert got == {2: True, 3: False, 4: False, 6: True}


FOLDS = [(["sent"], "sent"), (["sent", "replied"], "replied"), (["trial", "replied"], "trial"),
         (["sent", "trial"], "sent"), (["replied", "sent"], "replied"), (["sent", "stop", "replied"], "stop"),
         (["opened", "clicked"], "new"), (["opened", "trial", "sent"], "trial")]


def status_events(spark):
    rows, n = [], 0
    for p, (events, _) in enumerate(FOLDS):
        for s, e in enumerate(events):
            rows.append((n, p, 1, None, e, None, at(s)))
            n += 1
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, EVENT)


def test_prospect_status(spark):
    got = {r["prospect_id"]: r["status"] for r in E.prospect_status_fold(status_events(spark)).collect()}
    assert got == {p: want for p, (_, want) in enumerate(FOLDS)}
    people = spark.createDataFrame([(0, "paid"), (1, None), (5, "trial"), (99, "sent")], "id bigint, status string")
    with_start = {r["prospect_id"]: r["status"] for r in E.prospect_status_fold(status_events(spark), people).collect()}
    assert with_start == {0: "paid", 1: "replied", 5: "stop", 99: "sent"}


def test_clean_page_events(spark):
    rows = [(1, "/admin/x", "pageview", 1.0), (2, None, " view ", 2.5), (3, "/a", "  ", 1.0),
            (4, "/" + "x" * 400, "e" * 80, float("nan")), (5, "/b", "e", float("inf"))]
    df = spark.createDataFrame(rows, "id bigint, path string, event string, ms double").withColumns(
        {"session_id": F.lit("s" * 90), "meta": F.lit("m" * 5000)})
    got = {r["id"]: r for r in E.clean_page_events(df).collect()}
    assert sorted(got) == [2, 4, 5]
    assert (got[2]["path"], got[2]["event"], got[2]["ms"]) == ("/", "view", 3)
    assert (len(got[4]["path"]), len(got[4]["event"]), got[4]["ms"], len(got[4]["meta"])) == (300, 60, None, 4000)
    assert got[5]["ms"] is None and len(got[5]["session_id"]) == 80


def test_customer_status(spark):
    rows = [(1, "customer.subscription.updated", "canceled", 0), (1, "checkout.session.completed", None, 1),
            (1, "customer.subscription.updated", "paused", 2), (2, "checkout.session.completed", None, 1),
            (2, "invoice.payment_failed", None, 3), (2, "customer.subscription.updated", "trialing", 4),
            (3, "invoice.payment_failed", None, 1)]
    df = spark.createDataFrame([(c, t, s, at(x), i) for i, (c, t, s, x) in enumerate(rows)],
                               "customer_id bigint, type string, raw_status string, ts timestamp, id bigint")
    assert {r["customer_id"]: r["status"] for r in E.customer_status_fold(df).collect()} == {1: "active", 2: "active"}


def test_variants_continue_within_segments(spark):
    rows = [(1, 5, "a", None), (2, 1, "a", "A"), (3, 2, "a", None), (4, None, None, None), (5, 3, None, None),
            (6, 3, "a", None)]
    df = spark.createDataFrame(rows, "id bigint, rank int, segment string, subject_variant string")
    got = {r["id"]: r["subject_variant"] for r in O.assign_variants(df).collect()}
    assert got == {2: "A", 3: "B", 6: "C", 1: "D", 4: "A", 5: "B"}


def test_variants_number_a_large_segment_exactly(spark):
    df = spark.range(3000).selectExpr(
        "id", "cast(if(id % 50 = 0, null, (id * 7919) % 2000) as int) as rank", "'one' as segment",
        "cast(null as string) as subject_variant")
    rows = O.assign_variants(df).collect()
    order = sorted(rows, key=lambda r: (r["rank"] is not None, r["rank"] or 0, r["id"]))
    assert [r["subject_variant"] for r in order] == ["ABCD"[i % 4] for i in range(3000)]


def test_missing_ranks_come_first(spark):
    df = spark.createDataFrame([(1, 5, "x", None), (2, None, "x", None), (3, 2, "x", None)],
                               "id bigint, rank int, segment string, subject_variant string")
    assert {r["id"]: r["subject_variant"] for r in O.assign_variants(df).collect()} == {1: "C", 2: "A", 3: "B"}
    assert [r["id"] for r in O.select_prospects(df).collect()] == [2, 3, 1]


def test_link_codes_are_unique_and_kept(spark):
    df = spark.range(500).selectExpr("id", "if(id < 3, concat('keep', id), cast(null as string)) as link_code")
    got = O.ensure_link_codes(df, "pepper")
    rows = {r["id"]: r["link_code"] for r in got.collect()}
    assert len(set(rows.values())) == 500 and rows[0] == "keep0" and all(len(rows[i]) == 8 for i in range(3, 500))
    assert {r["id"]: r["link_code"] for r in O.ensure_link_codes(got, "other").collect()} == rows


@pytest.mark.parametrize("days,today,stops,bounces,sent,bounced,want", [
    (4, 0, 0, 0, 100, 0, (10, 10, False)), (5, 3, 0, 0, 100, 3, (15, 12, False)),
    (9, 18, 0, 0, 100, 0, (15, 0, False)), (9, 0, 1, 0, 100, 0, (15, 15, True)),
    (9, 0, 0, 2, 100, 0, (15, 15, True)), (9, 0, 0, 0, 100, 4, (15, 15, True))])
def test_ramp_and_halt(spark, days, today, stops, bounces, sent, bounced, want):
    health = spark.createDataFrame([(days, today, stops, bounces, sent, bounced)],
                                   "send_days bigint, sent_today bigint, stops_since bigint, bounces_since bigint,"
                                   "sent_total bigint, bounced_total bigint")
    r = O.ramp_and_halt(health).first()
    assert (r["target"], r["remaining"], r["halt"]) == want
    forced = O.ramp_and_halt(health, override=99).first()
    assert (forced["target"], forced["remaining"]) == (20, max(0, 20 - today))


def test_batch_order(spark):
    rows = [(1, 9, None), (2, 5, "lender"), (3, 8, "lender"), (4, 7, None), (5, 10, None), (6, 1, "community_leader")]
    df = spark.createDataFrame(rows, "id bigint, rank int, segment string").selectExpr(
        "*", "'a@b.com' as email", "'new' as status", "'A' as subject_variant", "cast(null as string) as inbox_flag",
        "id = 4 as near", "false as already_sent")
    assert [r["id"] for r in O.select_batch(df, 10).collect()] == [4, 2, 3, 1, 5]
    assert O.select_batch(df, -1).count() == 0


def test_trials(spark):
    rows = [(1, 7, "v1", at(0)), (2, 7, "v2", at(9)), (3, None, "v1", at(1)), (4, None, "v1", at(2)), (5, None, None, at(3))]
    df = spark.createDataFrame(rows, "id bigint, prospect_id bigint, vid string, started_at timestamp")
    got = {r["id"]: (r["active"], r["days_left"]) for r in O.trial_windows(df, "2026-01-07 00:00:02").collect()}
    assert got == {1: (True, 1), 3: (True, 1), 5: (True, 2)}


def test_access_requests(spark):
    rows = [(1, " A@b.co ", "lender", "x" * 80, ""), (2, "a@B.co", "other", "s", None), (3, "bad", "lender", "s", ""),
            (4, "c@d.org", "other", "s", "Bot Inc"), (5, "e@f.gh", "other", "s", None)]
    df = spark.createDataFrame(rows, "id bigint, email string, segment string, source string, company string")
    got = {r["id"]: (r["email"], r["segment"], len(r["source"])) for r in O.access_requests_dedupe(df).collect()}
    assert got == {1: ("a@b.co", "lender", 64), 5: ("e@f.gh", None, 1)}


def test_latest_send_however_old(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice([1, 1, 1, 1, 2, 3, None]), 9, None, rnd.choice(["sent", "clicked", "clicked", "opened"]), None,
             at(rnd.choice([0, 1, 3600, 7200, 90_000, 400_000]) + rnd.randrange(4))) for i in range(500)]
    df = spark.createDataFrame(rows, EVENT).repartition(7)
    for bucket in (1, 3600, 100_000):
        got = {r["id"]: (r["sent_at"], r["too_soon"]) for r in E.click_after_send_asof(df, 2, bucket).collect()}
        want = {}
        for r in rows:
            if r[4] == "clicked" and r[1] is not None:
                sent = max((s[-1] for s in rows if s[4] == "sent" and s[1] == r[1] and s[-1] <= r[-1]), default=None)
                want[r[0]] = (sent, sent is not None and (r[-1] - sent).total_seconds() < 2)
        assert got == want
