import json

import pytest

from pyspark.sql import functions as F

from parcelscope.operators.merge import last_per_key
from parcelscope.functions import text as T
from parcelscope.sources import feeds, sinks
from parcelscope.sources import parcel_roll as P


def roll_line(**cells):
    line = [""] * P.CELL_COUNT
    for name, value in cells.items():
        line[P.CELLS[name]] = value
    return "|".join(line)


ROLL = [
    roll_line(parcel="101-02-001c", owner_name=" GASWORKS COMPANY ", mail_line1="PO BOX 4372", mail_city="HOUSTON",
              mail_state="TX", mail_zip="77210", property_type="COMMERCIAL", deed_date="01072009",
              total_value="99400", land_class="100% 1.3", living_area="0"),
    roll_line(parcel="20221084", owner_name="DOE JANE", mail_line1="5 W OAK WY", mail_city="MESA",
              situs_line="5 OAK WAY 12", situs_suite="12", situs_city="MESA", situs_zip="85201",
              property_type="RESIDENTIAL", sale_date="3 2019", sale_price="250000", construction_year="1987",
              living_area="1450", total_value="0", land_class="55% 2.R; 45% 1.12", deed_date="02312005"),
    roll_line(parcel="20221085", owner_name="ROE RICK", mail_line1="9 ELM ST", mail_city="TEMPE",
              situs_line="7 ELM ST", situs_city="TEMPE", construction_year="87"),
    roll_line(parcel=" - ", owner_name="NO PARCEL"),
    "short|row", "", "   ",
]


def test_parcel_roll(spark, tmp_path):
    (tmp_path / "Secured_Master_BK100.txt").write_text("\r\n".join(ROLL) + "\r\n")
    (tmp_path / "notes.txt").write_text("ignored")
    rows, bad = P.scan_parcel_master(spark, str(tmp_path))
    got = {r["apn"]: r for r in rows.collect()}
    assert sorted(got) == ["10102001C", "20221084", "20221085"]
    gas, jane, rick = (got[k] for k in ("10102001C", "20221084", "20221085"))
    assert gas["owner_name"] == "GASWORKS COMPANY" and gas["owner_name_norm"] == "GASWORKS COMPANY"
    assert gas["mailing_address"] == "PO BOX 4372, HOUSTON, TX, 77210" and gas["situs_address"] is None
    assert (gas["legal_class"], gas["assessed_value"], gas["living_sqft"]) == ("1.3", 99400, None)
    assert (str(gas["last_sale_date"]), gas["absentee"]) == ("2009-01-07", False)
    assert (jane["situs_address"], jane["legal_class"], jane["year_built"]) == ("5 OAK WAY 12", "2.R", 1987)
    assert (str(jane["last_sale_date"]), jane["last_sale_price"], jane["assessed_value"]) == ("2019-03-01", 250000, None)
    assert rick["absentee"] and rick["year_built"] is None and rick["last_sale_date"] is None
    assert {tuple(r) for r in P.quarantine_rows(bad).collect()} == {("too few cells", 1), ("no parcel", 1)}


def features(spark, tmp_path, *rows):
    (tmp_path / "page.json").write_text(json.dumps(
        {"fields": [], "features": [{"attributes": r} for r in rows], "exceededTransferLimit": True}))
    rows, bad = feeds.scan_features(spark, str(tmp_path))
    return feeds.require_good(rows, bad, "test")


def test_tax_and_county_feeds(spark, tmp_path):
    rows = features(
        spark, tmp_path,
        {"OBJECTID": 1, "APN": "202-21-084", "PropertyFullStreetAddress": "5 W OAK WAY", "Shape__Area": 1.5},
        {"OBJECTID": 2, "PARCELNUM": "9-9", "SITE_ADDR": "1 ELM"}, {"OBJECTID": 3},
        {"OBJECTID": 4, "CodeCaseNumber": "V1", "Opened": 1704067200000, "Status": "Open", "Address": "7 FIR"})
    tax = {r["apn"]: r for r in feeds.map_tax_delinquent(rows).collect()}
    assert sorted(tax) == ["20221084", "99"] and tax["20221084"]["status"] == "open"
    assert tax["99"]["situs_address"] == "1 ELM" and json.loads(tax["20221084"]["raw"])["Shape__Area"] == "1.5"
    county = {r["external_id"]: r for r in feeds.map_code_county(rows).collect()}
    assert sorted(county) == ["1", "2", "3", "V1"]
    assert str(county["V1"]["event_date"]) == "2024-01-01" and county["1"]["apn"] == "20221084"


def test_case_feeds(spark, tmp_path):
    rows = features(
        spark, tmp_path,
        {"OBJECTID": 1, "CaseNo": "C1", "CaseStatus": "Open", "CaseOpenDate": 0},
        {"OBJECTID": 2, "CaseNo": "C1", "CaseStatus": "Closed"}, {"OBJECTID": 3, "Id": "{g}"},
        {"ViolationID": 7, "StreetNumber": 0, "StreetDirection": "N", "StreetName": "HAYDEN", "ParcelCode": "1-2"})
    tempe = feeds.map_code_tempe(rows).withColumn("seq", F.get_json_object("raw", "$.OBJECTID").cast("int"))
    merged = {r["external_id"]: r for r in last_per_key(tempe, ["source", "external_id"], "seq").collect()}
    assert {k: r["status"] for k, r in merged.items()} == {"C1": "Closed", "{g}": None}  # one signal per case
    scottsdale = feeds.map_code_scottsdale(rows).collect()
    assert [(r["external_id"], r["apn"], r["situs_address"]) for r in scottsdale] == [("7", "12", "N HAYDEN")]
    assert feeds.missing_ids(rows, "CaseNo", "Id", "OBJECTID").count() == 1


def test_bad_pages_are_counted_and_stop_a_feed(spark, tmp_path):
    good = json.dumps({"features": [{"attributes": {"OBJECTID": 1, "APN": "1-2"}}]})
    pages = {"a": good, "a2": good, "b": '{"error": {"code": 500}}', "c": "<html>503</html>", "d": good[:-4], "e": " ", "f": "[1]"}
    for name, text in pages.items():
        (tmp_path / f"{name}.json").write_text(text)
    rows, bad = feeds.scan_features(spark, str(tmp_path))
    assert [r["attributes"]["APN"] for r in rows.collect()] == ["1-2"]
    assert sorted(r["reason"] for r in bad.collect()) == ["empty", "error answer", "no features", "not JSON", "not JSON"]
    with pytest.raises(Exception, match="test: bad pages: 5"):
        feeds.require_good(rows, bad, "test").collect()


def test_junk_numbers_never_end_a_job(spark):
    cells = ["12", "12.5", "-3", "1e3", "0", "10d", "12F", "NaN", "Infinity", "1e999", "3000000000", "", None, "x"]
    got = spark.createDataFrame([(c,) for c in cells], "c string").select(T.numeric_or_null("c").alias("n")).collect()
    assert [r["n"] for r in got] == [12, 12.5, -3, 1000, None, None, None, None, None, None, 3e9, None, None, None]
    line = ["1-2"] + [""] * 38
    line[29] = "3000000000"
    good, _ = P.parse_parcel_lines(spark.createDataFrame([("|".join(line),)], "value string"))
    assert good.first()["living_sqft"] is None


def test_row_feed_drops_missing_ids(spark, tmp_path):
    rows = [{"permit_number": "P1", "opened_date": "2026-01-02T00:00:00", "parcel_number": "1-2"},
            {"record_id": "R2"}, {"status": "x"}, {"permit_number": "undefined"}]
    (tmp_path / "page.json").write_text(json.dumps(rows))
    got = feeds.map_code_mesa(feeds.scan_socrata(spark, str(tmp_path))[0]).orderBy("external_id").collect()
    assert [(r["external_id"], r["apn"], str(r["event_date"])) for r in got] == [
        ("P1", "12", "2026-01-02"), ("R2", None, "None")]


def case_page(heading, **fields):
    rows = "".join(
        f'''<div class="row">
        <div class="col-md-3"><p><strong>{label}:</strong></p></div>
        <div class="col-md-9">
            <p> {value} </p>
        </div></div>''' for label, value in fields.items())
    return f"<html><h1>{heading}</h1>{rows}</html>"


def test_code_case_pages(spark, tmp_path):
    fields = {"Address": "2501 E FIR ST PHOENIX 85016", "Case Status": "CLOSED &amp; PAID",
              "Responsible Party": "DOE JOHN Q", "Case Opened": "6/09/2026", "Inspector": "X"}
    (tmp_path / "PEF2026-18550.html").write_text(case_page("Case Details - PEF2026-18550", **fields))
    (tmp_path / "PEF2026-2.html").write_text(case_page("Case Details - PEF2026-2", Address="", **{"Case Opened": "soon"}))
    (tmp_path / "PEF2026-1.html").write_text(case_page("Runtime Error"))
    got = {r["external_id"]: r for r in feeds.extract_code_case_html(feeds.scan_html(spark, str(tmp_path))).collect()}
    assert sorted(got) == ["PEF2026-18550", "PEF2026-2"]
    r = got["PEF2026-18550"]
    assert (r["status"], r["owner_name"], str(r["event_date"])) == ("CLOSED & PAID", "DOE JOHN Q", "2026-06-09")
    assert r["situs_address"] == "2501 E FIR ST PHOENIX 85016"
    assert got["PEF2026-2"]["situs_address"] is None and got["PEF2026-2"]["event_date"] is None


RECENT = """<span id="ctl00_ContentPlaceHolder1_lblRecNum">2026 0123</span>
<span id="ctl00_ContentPlaceHolder1_lblRecDate">6/9/2026 8:47:00 AM</span>
<select id="ctl00_ContentPlaceHolder1_lbRecDocCode"><option>N/TR SALE</option></select>"""
INDEXED = RECENT.replace("0123", "0124") + (
    '<span id="ctl00_ContentPlaceHolder1_lblRecDocName">ZBS LAW LLP<br>'
    '<a href="#">PUBLIC JOHN Q</a><br/>BIG BANK NA</span>')


def test_recorder_pages(spark):
    pages = spark.createDataFrame([("a", RECENT), ("b", INDEXED), ("c", "<p>busy</p>")], "page_id string, html string")
    got = feeds.extract_recorder_html(pages, "recorder_nots", "trustee_sale").orderBy("external_id").collect()
    assert [(r["external_id"], r["owner_name"], str(r["event_date"])) for r in got] == [
        ("20260123", None, "2026-06-09"), ("20260124", "PUBLIC JOHN Q", "2026-06-09")]


def signals_of(*entries):
    return [dict(zip(("type", "source", "external_id", "source_url"), e)) for e in entries]


def test_export_layouts(spark, tmp_path):
    report = spark.sql("""
      select '1' apn, 'probate' signal_type, 's' source, date'2026-01-02' event_date, 'SMITH JOHN/MARY' owner_name,
        '5 W OAK ST' situs_address, 'MESA' situs_city, '85201' situs_zip, 70 score, true is_hot, 2 stacked_types,
        'lien,probate' signal_types, '9 ELM, TEMPE, AZ, 85283' mailing_address, true absentee, false is_entity,
        250000D assessed_value, cast(null as double) last_sale_price, date'2000-01-01' last_sale_date, 26 years_owned,
        date'2026-01-11' est_auction_date, timestamp'2026-01-01 00:00:00' first_seen,
        array(named_struct('type', 'lien', 'source', 's', 'external_id', 'L1', 'source_url', 'u1'),
              named_struct('type', 'probate', 'source', 's', 'external_id', 'P1', 'source_url', 'u1')) signals""")
    row = sinks.report_export(report, "2026-01-02 00:00:00").first()
    assert len(row) == 27
    assert (row["owner_first"], row["owner_last"], row["mailing_zip"]) == ("JOHN", "SMITH", "85283")
    assert (row["recorder_doc_number"], row["court_case_number"], row["source_urls"]) == ("L1", "P1", "u1")
    assert row["days_to_auction"] == 9
    mapped = sinks.report_export(report, "2026-01-02 00:00:00", "batchleads")
    assert len(mapped.columns) == 24 and mapped.first()["Property State"] == "AZ"
    sinks.sink_report_csv(report, str(tmp_path / "csv"), "2026-01-02 00:00:00")
    written = next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()
    assert written[0].split(",")[:3] == ["rank", "score", "hot"]
    assert '"9 ELM, TEMPE, AZ, 85283"' in written[1]


def test_export_round_trip_keeps_quotes_breaks_and_nulls(spark, tmp_path):
    rows = [(1, 'say "hi", then\nleave', None, ""), (2, "", "a,b", None), (3, None, '"', "x\r\ny"), (4, "\\", "'", " pad ")]
    schema = "rank int, a string, b string, c string"
    path = str(tmp_path / "out")
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.csv(path, header=True, quote='"', escape='"', emptyValue='""', nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    assert sorted(map(tuple, sinks.read_report_csv(spark, path, df.schema).collect())) == rows


def test_title_is_raw_text(spark):
    titles = ["a &amp; b", "&quot;x&quot; &amp;lt;", " <b>c</b> ", "\n d\t", "\u00a0e\u3000", ""]
    pages = spark.createDataFrame([(i, f"<title>{t}</title>") for i, t in enumerate(titles)] + [(9, None)], "i int, html string")
    got = [r["t"] for r in pages.select("i", feeds.title_text(F.col("html")).alias("t")).orderBy("i").collect()]
    assert got == ["a & b", "&quot;x&quot; &lt;", "<b>c</b>", "\n d\t", "e", "", None]


def test_pages_in_bundles_are_the_pages_of_files(spark, tmp_path):
    pages = [("1", "<p>a</p>\n\n<p>\u2028\u00e9\U0001f525\r\n</p> "), ("2", ""), ("3", '{"page_id": "9"}\\n\x01'), ("4", None)]
    df = spark.createDataFrame([p for p in pages for _ in range(2)], "page_id string, html string").repartition(3)
    feeds.land_pages(df, str(tmp_path / "bundles"))
    read = feeds.scan_bundles(spark, str(tmp_path / "bundles"))
    assert sorted(map(tuple, read.distinct().collect())) == sorted(pages) and read.count() == 8
    filled = [p for p in pages if p[1]]  # Spark reads no row of an empty file
    for name, html in filled:
        (tmp_path / "files").mkdir(exist_ok=True)
        (tmp_path / "files" / f"{name}.html").write_bytes(html.encode())
    assert sorted(map(tuple, feeds.scan_html(spark, str(tmp_path / "files")).collect())) == sorted(filled)
    assert len(list((tmp_path / "bundles").glob("part-*"))) <= 3  # not a file for each page
