"""Feeds to report over two days, through written tables."""
import datetime as dt
import json

from pyspark.sql import functions as F

from parcelscope.plans.daily import DailyRun
from parcelscope.schemas import PROPERTIES, PROSPECTS
from parcelscope.sources import feeds


def records(spark, cases, day):
    """Glendale and probate records of a day; cases: (id, street) and names: (id, owner)."""
    rows = [json.dumps({"features": [{"attributes": {
        "CodeCaseNumber": i, "StreetNum": n, "StreetName": s, "CityName": "GLENDALE",
        "RequestDate": int(dt.datetime(2026, 1, day, tzinfo=dt.timezone.utc).timestamp() * 1000),
        "RequestStatus": status}}]}) for i, n, s, status in cases]
    pages = spark.createDataFrame([(r,) for r in rows], "value string")
    code = feeds.map_code_glendale(feeds.explode_features(pages))
    court = spark.createDataFrame([("PB1", f"""<div id="tblForms3"><div class="col-lg-4">John  A Smith</div>
      <div class="col-lg-3">Decedent</div></div><div><div class="col-4 m-visibility">Filing Date</div>
      <div>1/{day}/2026</div></div>""")], "page_id string, html string")
    both = feeds.combine_sources(code, feeds.extract_probate_html(court))
    return both.withColumn("seq", F.monotonically_increasing_id())


def test_two_days(spark, tmp_path):
    row = lambda apn, owner, address: (
        apn, address, "GLENDALE", "85301", owner, None, None, None, "PO BOX 1", True, None, None, None, None,
        dt.date(2010, 1, 1), None, 1000.0, None)
    parcels = spark.createDataFrame(
        [row("1", "SMITH JOHN A", "5 W OAK AVE"), row("2", "DOE JANE", "7 W OAK AVE")], PROPERTIES)
    people = spark.createDataFrame(
        [(i, i, f"Firm {i}", None, "a@b.c", None, None, None, None, "new", "85301", None, "A", None)
         for i in (1, 2)], PROSPECTS)
    root = str(tmp_path / "store")

    first = DailyRun(spark, root, records(spark, [("C1", "5", "W OAK AVE", "Open"), ("C2", "7", "W OAK AVE", "Open")], 9),
                     parcels, people, "2026-01-10 12:00:00")
    assert {r["warn"] for r in first.run().collect()} == {False}
    got = {r["external_id"]: (r["apn"], r["match_confidence"]) for r in first.signals.collect()}
    assert got == {"C1": ("1", "exact"), "C2": ("2", "exact"), "PB1": ("1", "exact")}
    scores = {r["apn"]: (r["score"], r["breakdown"]["live_count"]) for r in first.scores.collect()}
    assert scores["2"] == (60, 1) and scores["1"][0] > 100 and scores["1"][1] == 2
    text = [r["value"] for r in spark.read.text(first.store.path("report")).collect()]
    assert text[0].startswith("# ") and any("SMITH JOHN A" in x for x in text)
    assert [(r["prospect_id"], r["rank"], r["match_tier"]) for r in first.matches.orderBy("prospect_id", "rank").collect()] == [
        (1, 1, "zip"), (1, 2, "zip"), (2, 1, "zip"), (2, 2, "zip")]
    assert {r["source"]: (r["rows_found"], r["rows_new"]) for r in first.runs.collect()} == {
        "code_glendale": (2, 2), "court_probate": (1, 1)}

    again = DailyRun(spark, root, records(spark, [("C1", "5", "W OAK AVE", "Closed"), ("C3", "9", "N FIR ST", "Open")], 10),
                     parcels, people, "2026-01-11 12:00:00")
    again.run()
    second = {r["external_id"]: r for r in again.signals.collect()}
    assert sorted(second) == ["C1", "C2", "C3", "PB1"]
    assert (second["C1"]["status"], second["C1"]["apn"]) == ("Closed", "1")
    assert second["C1"]["created_at"] == dt.datetime(2026, 1, 10, 12) and second["C3"]["match_confidence"] == "none"
    assert again.runs.count() == 4
    # Only what arrived today is news; the parcel stays scored.
    assert again.report(24, 50).count() == 0
