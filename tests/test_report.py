import datetime as dt

from pyspark.sql import functions as F

from parcelscope.operators import leads as L
from parcelscope.operators import merge as M
from parcelscope.operators import monitor as N
from parcelscope.operators import report as R
from parcelscope.schemas import PROPERTIES, SIGNALS
from parcelscope.sources import sinks

AS_OF = "2026-01-15 12:00:00"
NOW = dt.datetime(2026, 1, 15, 12)


def signal(i, apn, kind="probate", filed=1, seen_hours=1, owner=None, source="s"):
    date = NOW.date() - dt.timedelta(days=filed) if filed is not None else None
    seen = NOW - dt.timedelta(hours=seen_hours)
    return (kind, source, str(i), apn, f"u{i}", date, "open", owner, None, "{}", None, False, None,
            seen.date(), seen, seen)


def frames(spark, signals, parcels, scores):
    s = spark.createDataFrame(signals, SIGNALS)
    p = spark.createDataFrame(
        [(a, addr, "MESA", "85201", owner, None, None, None, "PO BOX 1", True, None, None, None, None,
          dt.date(2010, 1, 15), None, 1000.0, None) for a, owner, addr in parcels], PROPERTIES)
    c = spark.createDataFrame(scores, "apn string, score int, hot boolean")
    return s, p, c


def sample(spark):
    return frames(
        spark,
        [signal(1, "A", "probate", 1), signal(2, "A", "lien", 3), signal(3, "A", "trustee_sale", 200, 5000),
         signal(4, "B", "lien", None), signal(5, "C", "lien", 30), signal(6, None, "divorce", 2, owner="DOE JANE"),
         signal(7, None, "divorce", 5, owner="DOE JANE"), signal(8, None, "divorce", 2), signal(9, None, "divorce", 3),
         signal(10, "D", "lien", 1), signal(11, "Z", "lien", 1, owner="ROE RICK"), signal(12, "A", "probate", 1, 25)],
        [("A", "SMITH JOHN", "1 OAK ST"), ("B", "JONES AMY", None), ("C", "LEE PAT", "2 OAK ST"),
         ("D", "ACME LLC", "3 OAK ST")],
        [("A", 80, True), ("B", 90, True), ("D", 99, True)])


def keys(df):
    return [(r["apn"], r["owner_name"], r["signal_type"]) for r in df.collect()]


def test_daily_report_rows(spark):
    s, p, c = sample(spark)
    got = R.daily_report(s, p, c, AS_OF)
    # B is undated, C older than the filed window, D an entity, the ownerless divorce has no owner.
    assert keys(got) == [("A", "SMITH JOHN", "probate"), ("Z", "ROE RICK", "lien"), (None, "DOE JANE", "divorce")]
    first = got.first()
    assert (first["stacked_types"], first["signal_types"]) == (3, "lien,probate,trustee_sale")
    assert first["years_owned"] == 16
    assert first["est_auction_date"] == NOW.date() - dt.timedelta(days=200) + dt.timedelta(days=90)
    everyone = R.daily_report(s, p, c, AS_OF, homeowners=False, filed_days=None)
    assert keys(everyone)[:3] == [("D", "ACME LLC", "lien"), ("B", "JONES AMY", "lien"), ("A", "SMITH JOHN", "probate")]
    assert everyone.count() == 7  # one row for all divorces without an owner
    assert keys(R.daily_report(s, p, c, AS_OF, limit=1)) == [("A", "SMITH JOHN", "probate")]


def test_arrival_is_strict_and_phoenix_day_counts(spark):
    s, p, c = frames(spark, [signal(1, "A", seen_hours=24), signal(2, "B", filed=15), signal(3, "C", filed=14)], [], [])
    assert R.arrival_window(s, AS_OF, 24).count() == 2
    # 03:00 UTC on the 16th is still the 15th in Phoenix, so the first day inside is the same.
    late = "2026-01-16 03:00:00"
    assert R.filed_window_days(s, late, 14).count() == R.filed_window_days(s, AS_OF, 14).count() == 2
    assert R.filed_window_hours(s, late, 14 * 24).count() == 1  # the UTC day has moved on


def test_counts_and_headline(spark):
    s, p, c = sample(spark)
    counts = {r["signal_type"]: (r["n"], r["older_n"]) for r in R.report_counts(s, p, AS_OF).collect()}
    assert counts == {"probate": (1, 0), "divorce": (1, 0), "lien": (1, 2)}
    total = R.report_totals(R.report_counts(s, p, AS_OF)).first()
    assert (total["n"], total["older_n"]) == (3, 2)
    lines = [r["line"] for r in sinks.report_markdown(
        R.daily_report(s, p, c, AS_OF), R.report_counts(s, p, AS_OF), AS_OF).collect()]
    assert lines[0] == "# Daily Motivated Report for 2026-01-15"
    assert "3 new signals in the last 24h, homeowners only." in lines
    assert "plus 2 older filings newly detected (backfill), hidden below." in lines
    assert any(x.startswith("Freshest filings: divorce Jan 13, lien Jan 14 and probate Jan 14") for x in lines)
    assert lines[-1].startswith("| 3 | - | 2026-01-13 | - | DOE JANE | (unresolved) | - | - | N | - | - | divorce |")


def test_provenance_and_masking(spark):
    s, p, c = sample(spark)
    rows = {r["apn"]: r for r in R.web_report(s, p, c, AS_OF).collect()}
    assert [e["external_id"] for e in rows["A"]["signals"]] == ["1", "2", "3"]
    assert [e["external_id"] for e in rows[None]["signals"]] == ["6"]
    masked = R.masked_report(R.web_report(s, p, c, AS_OF), 2).collect()
    assert [r["owner_name"] for r in masked][0] in ("S. J.", "JONES AMY") and len(masked) == 2


def test_report_does_not_depend_on_row_order(spark):
    s, p, c = sample(spark)
    shuffled = R.daily_report(s.orderBy(F.desc("external_id")).repartition(3), p.repartition(2), c, AS_OF)
    assert shuffled.collect() == R.daily_report(s, p, c, AS_OF).collect()


def test_busy_parcel_stays_one_row(spark):
    s, p, c = frames(spark, [signal(i, "HOT", "lien", i % 9) for i in range(500)], [("HOT", "LEE PAT", "x")], [])
    rows = R.daily_report(s, p, c, AS_OF).collect()
    assert len(rows) == 1 and rows[0]["event_date"] == NOW.date()


def test_lead_list_actions(spark):
    parcels = [(a, "X", "1 OAK ST") for a in "ABC"]
    _, p, _ = frames(spark, [signal(1, "A")], parcels, [("A", 1, True)])
    scores = spark.sql("""
      select apn, score, hot, array('lien') signal_types, named_struct('types', array('lien'), 'modifiers',
        named_struct('absentee', true, 'high_equity', false, 'long_tenure', false), 'fresh', false,
        'latest_date', date'2026-01-01') components
      from values ('A', 10, true), ('B', 30, false), ('C', 20, true) t(apn, score, hot)""")
    acts = spark.createDataFrame([("A", "saved"), ("B", "hidden")], "apn string, action string")
    got = [(r["apn"], r["saved"]) for r in L.lead_list(scores, p, acts).collect()]
    assert got == [("C", False), ("A", True)] or sorted(got) == [("A", True), ("C", False)]
    assert L.lead_list(scores, p, acts, include_hidden=True).count() == 3
    assert [r["apn"] for r in L.lead_list(scores, p, acts, saved_only=True).collect()] == ["A"]
    assert [r["apn"] for r in L.top_leads(scores, p, hot_only=True, min_score=15, city="mes").collect()] == ["C"]


def batch(spark, rows):
    data = [("probate", "s", i, apn, "u", dt.date(2026, 1, 1), status, "o", None, "{}", n)
            for n, (i, apn, status) in enumerate(rows)]
    return spark.createDataFrame(data, "signal_type string, source string, external_id string, apn string,"
                                 "source_url string, event_date date, status string, owner_name string,"
                                 "situs_address string, raw string, seq bigint")


def test_merge_rules(spark):
    empty = spark.createDataFrame([], SIGNALS)
    first = batch(spark, [("1", "9", "open"), ("2", None, "open"), ("2", None, "again")])
    snap, metrics = M.merge_signals(empty, first, "2026-01-02 00:00:00")
    assert [tuple(r) for r in metrics.collect()] == [("s", 3, 2)]
    rows = {r["external_id"]: r for r in snap.collect()}
    assert rows["2"]["status"] == "again"
    second = batch(spark, [("1", None, "closed")]).withColumn("signal_type", F.lit("x"))
    snap2, metrics2 = M.merge_signals(snap, second, "2026-01-03 00:00:00")
    r = {x["external_id"]: x for x in snap2.collect()}
    assert (r["1"]["apn"], r["1"]["status"], r["1"]["signal_type"]) == ("9", "closed", "probate")
    assert r["1"]["created_at"] == rows["1"]["created_at"] and r["1"]["updated_at"].day == 3
    assert r["2"]["updated_at"] == rows["2"]["updated_at"]
    assert [tuple(x) for x in metrics2.collect()] == [("s", 1, 0)]
    again, _ = M.merge_signals(snap2, second, "2026-01-03 00:00:00")
    assert sorted(map(str, again.collect())) == sorted(map(str, snap2.collect()))
    nulls = M.merge_signals(snap2, second.withColumn("status", F.lit(None).cast("string")), "2026-01-04 00:00:00")[0]
    assert {x["external_id"]: x["status"] for x in nulls.collect()}["1"] is None  # a re-observed NULL overwrites


def runs(spark, rows):
    data = [(f"{s}{i}", s, started, started, found, 0, status, err, None)
            for i, (s, started, status, found, err) in enumerate(rows)]
    return spark.createDataFrame(data, "id string, source string, started_at timestamp, finished_at timestamp,"
                                 "rows_found int, rows_new int, status string, error string, source_max_date date")


def test_medians_use_the_last_fourteen_ok_runs(spark):
    day = lambda d: dt.datetime(2026, 1, d)
    r = runs(spark, [("a", day(i), "ok", i, None) for i in range(1, 17)]
             + [("a", day(20), "ok", 999, None), ("a", day(5), "error", 999, None), ("a", day(6), "ok", None, None)])
    got = {x["source"]: x["median"] for x in N.recent_median(r, "2026-01-17 00:00:00").collect()}
    assert got == {"a": 9.5}


def test_volume_drops(spark):
    today = spark.createDataFrame([("zero", "ok", 0), ("small", "ok", 4), ("fine", "ok", 5), ("tiny", "ok", 1),
                                   ("new", "ok", 0), ("bad", "error", 0), ("quiet", "ok", 0)],
                                  "source string, status string, found int")
    med = spark.createDataFrame([("zero", 1.0), ("small", 50.0), ("fine", 50.0), ("tiny", 49.0), ("bad", 9.0),
                                 ("quiet", 0.0)], "source string, median double")
    got = {r["source"]: r["warn"] for r in N.volume_drop(today, med).collect()}
    assert got == {"zero": True, "small": True, "fine": False, "tiny": False, "new": False, "quiet": False}
    lines = [r["line"] for r in sinks.health_lines(today, N.volume_drop(today, med)).collect()]
    assert lines[0] == "## Source health" and "| zero | 0 | 1 | warn |" in lines and "| bad | — | — | error |" in lines


def test_day_status(spark):
    t = lambda d, h: dt.datetime(2026, 1, d, h)
    r = runs(spark, [("a", t(10, 13), "ok", 5, None), ("b", t(11, 6), "warn", 5, None), ("c", t(11, 7), "ok", 5, None),
                     ("d", t(12, 6), "error", None, "x"), ("e", t(11, 20), "ok", 5, "busy-stop")])
    s = N.pipeline_day_status(r).first()
    assert (str(s["day"]), s["n_sources"], s["n_ok"], s["n_error"], s["error_sources"]) == ("2026-01-11", 3, 2, 1, ["d"])
    done = N.sources_complete_today(r, ["c", "e"], "2026-01-12 03:00:00").first()
    assert (done["n_done"], done["complete"]) == (1, False)
    assert N.sources_complete_today(r, ["c"], "2026-01-12 03:00:00").first()["complete"]
    assert N.todays_run(r, "b", "2026-01-12 03:00:00").count() == 0


def test_registered_numbers_count_the_rows_of_a_page(spark, monkeypatch):
    """The page shows the best 5,000 rows of each report, and its SQL counts those."""
    from parcelscope.plans.registry import QUERIES, Tables

    parcels = [(f"P{i}", "SMITH JOHN", "1 OAK ST") for i in range(5003)]
    s, p, c = frames(spark, [signal(i, a[0]) for i, a in enumerate(parcels)], parcels, [])
    for name, table in (("signals", s), ("properties", p), ("scores", c)):
        monkeypatch.setattr(Tables, name, table, raising=False)
    monkeypatch.setattr(Tables, "__init__", lambda self, spark, _: self.__dict__.update(spark=spark, as_of=AS_OF))
    import parcelscope.plans.catalog  # noqa: F401  registers the queries
    row = QUERIES["report_numbers"](spark, "")
    assert (row.first()["n24"], row.first()["n7"]) == (5000, 5000)
    assert R.report_numbers(s, p, c, AS_OF, limit=7).first()["n7"] == 7
    assert R.report_numbers(s, p, c, AS_OF).first()["n7"] == 5003
