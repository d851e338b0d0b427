import datetime as dt

import pytest
from pyspark.sql import functions as F

from parcelscope.functions import dates as D
from parcelscope.functions import display as X
from parcelscope.functions import names as N
from parcelscope.functions import sql_face
from parcelscope.functions import text as T


def table(spark, fn, inputs):
    """fn over a column of inputs, in input order."""
    df = spark.createDataFrame([(i, s) for i, s in enumerate(inputs)], "i int, s string")
    rows = df.select("i", fn(F.col("s")).alias("o")).orderBy("i").collect()
    return [r["o"] for r in rows]


def test_parcel_and_owner_normalisation(spark):
    assert table(spark, T.normalize_apn, ["202-21-084", "101 02 001c", None]) == [
        "20221084", "10102001C", ""]
    assert table(spark, T.normalize_owner_name, ["Smith, John Tr.", "ACME L L C", "THE CO OP"]) == [
        "SMITH JOHN", "ACME", "THE OP"]
    assert table(spark, T.sorted_name_key, ["Robert L Stark", "STARK ROBERT L"]) == [
        "L ROBERT STARK"] * 2


def test_street_only_strips_a_trailing_city(spark):
    got = table(spark, T.street_only, [
        "5932 W PASADENA AVE GLENDALE", "9405 W GLENDALE AVE", "1 Main St. Sun City",
        "16225 N OAK AVE, TEMPE, AZ, 85283", None])
    assert got == ["5932 W PASADENA AVE", "9405 W GLENDALE AVE", "1 MAIN ST",
                   "16225 N OAK AVE TEMPE AZ 85283", ""]


SAME = [
    ("1919 E FLORIAN", None, "85204", "1919 E FLORIAN AVE", None, "85204", True),
    ("15321 WHITE HORSE DR", None, "85375", "15321 W WHITE HORSE DR", None, "85375", True),
    ("2031 E TAXIDEA WY", None, "85048", "2031 E TAXIDEA WAY", None, "85048", True),
    ("8601 E VALLEY VW", None, "85022", "8601 E VALLEY VIEW RD", None, "85022", True),
    ("123 MAIN ST", None, None, "123 MAIN ST", None, "85001", True),
    ("123 MAIN ST", None, "85001", "123 MAIN ST", None, "85002", False),
    ("123 MAIN ST", None, "85001", "456 OAK AVE", None, "85001", False),
    ("712 N NORFOLK CIR", "MESA", "85205", "712 N NORFOLK CIR", "MESA", "85201", True),
    ("712 N NORFOLK CIR", "MESA", "85205", "712 N NORFOLK CIR", "TEMPE", "85205", False),
    ("712 N NORFOLK CIR", "MESA", "85205", "PO BOX 1234", "MESA", "85205", False),
    ("123 MAIN ST", "Mesa", "85201", "123 MAIN ST", "MESA", "85205", True),
    ("12 E OAK ST APT 4", None, None, "12 E OAK ST #9", None, None, True),
    ("N ST", None, None, "S AVE", None, None, False),
]


def test_same_street_address(spark):
    df = spark.createDataFrame(
        [(i, *row) for i, row in enumerate(SAME)],
        "i int, a string, ca string, za string, b string, cb string, zb string, want boolean")
    same = T.same_street_address("a", "ca", "za", "b", "cb", "zb")
    bad = [r for r in df.withColumn("got", same).collect() if r["got"] != r["want"]]
    assert bad == []


def test_parcel_cells(spark):
    df = spark.createDataFrame(
        [("12 OAK ST 7", "7"), ("12 OAK ST", "7"), ("12 OAK ST", ""), ("", "")], "a string, s string")
    got = [r[0] for r in df.select(T.compose_situs_address("a", "s")).collect()]
    assert got == ["12 OAK ST 7", "12 OAK ST 7", "12 OAK ST", None]
    assert table(spark, T.parse_legal_class, ["100% 1.3", "55% 2.R; 45% 1.12", ""]) == [
        "1.3", "2.R", None]
    assert table(spark, T.numeric_or_null, ["0", "12", "x", " 7\t", ""]) == [None, 12, None, 7, None]
    assert table(spark, T.year_built, ["1999", "19", "99999", ""]) == [1999, None, None, None]


def test_persons_and_keys(spark):
    names = ["DUGAN LESLIE R/SYLVIA D", "BIRACH KAREN A/JAMES/WEAVER SUSAN M", "ACME LLC",
             "SMITH JOHN AND MARY", "JONES FAMILY TRUST", "Mary Ann O'Brien-Lee", None]
    keys = table(spark, N.property_keys, names)
    assert keys == [["DUGAN|LESLIE", "DUGAN|SYLVIA"],
                    ["BIRACH|KAREN", "BIRACH|JAMES", "WEAVER|SUSAN"], [],
                    ["SMITH|JOHN", "SMITH|MARY"], [], ["MARY|ANN"], []]
    people = table(spark, N.persons_from_owner, names[:2])
    assert [tuple(p) for p in people[0]] == [("DUGAN", "LESLIE", "R"), ("DUGAN", "SYLVIA", "D")]
    assert [p["middle"] for p in people[1]] == ["A", None, "M"]
    assert table(spark, N.signal_keys, ["John Q Public", "ACME LLC", "MADONNA"]) == [
        ["JOHN|PUBLIC", "PUBLIC|JOHN"], [], []]
    assert table(spark, N.signal_middles, ["John Quincy Public"]) == [["PUBLIC", "QUINCY"]]
    assert table(spark, N.entity_key, ["The Acme LLC", "THE", "A B"]) == ["=ACME LLC", None, None]
    assert table(spark, N.is_entity_name, ["SMITH FAMILY TRUST", "CITY OF MESA", "", None]) == [
        False, True, True, True]


def test_entity_owner_keeps_trusts_and_estates(spark):
    got = table(spark, T.is_entity_owner, [
        "SMITH FAMILY TRUST", "ESTATE OF JANE DOE", "Desert Homes Inc", "TO FOLLOW", "ToFollow",
        "N/A", "COOPER JOHN", "SUNSET HOA", None])
    assert got == [False, False, True, True, True, True, False, True, None]


def test_dates(spark):
    assert table(spark, D.parse_deed_date, ["03092005", "02312005", "13012005", "01011899", ""]) == [
        dt.date(2005, 3, 9), None, None, None, None]
    assert table(spark, D.parse_sale_date, ["3 2019", "12 2020", "13 2020", "2020", ""]) == [
        dt.date(2019, 3, 1), dt.date(2020, 12, 1), None, None, None]
    assert table(spark, D.parse_us_date, ["6/9/2026 8:47:00 AM", " 6/09/2026 ", "x"]) == [
        dt.date(2026, 6, 9), dt.date(2026, 6, 9), None]
    assert table(spark, lambda c: D.phoenix_date(c.cast("timestamp")),
                 ["2026-10-05 03:00:00", "2026-10-05 07:00:00"]) == [
        dt.date(2026, 10, 4), dt.date(2026, 10, 5)]
    assert table(spark, D.epoch_ms_date, ["0", "1704067200000", None]) == [
        None, dt.date(2024, 1, 1), None]


def test_ages_floor_and_clamp(spark):
    as_of = "2026-01-01 12:00:00"
    got = table(spark, lambda c: D.age_in_days(c.cast("date"), as_of),
                ["2026-01-01", "2025-12-31", "2026-02-01", None])
    assert got == [0, 1, 0, None]
    ago = table(spark, lambda c: D.relative_time(c, as_of), [
        "2026-01-01", "2025-12-31", "2025-12-20", "2025-12-10", "2025-10-01", "2024-12-01"])
    assert ago == ["today", "1 day ago", "12 days ago", "3 weeks ago", "3 months ago", "1 year ago"]


def test_date_chunks_cover_without_gaps(spark):
    df = spark.sql("select date'2026-10-01' s, date'2026-10-08' e, 1 id "
                   "union all select date'2026-10-05', date'2026-10-05', 2 "
                   "union all select date'2026-10-06', date'2026-10-05', 3")
    rows = D.date_chunks(df, "s", "e", 3).orderBy("id", "chunk_start").collect()
    spans = [(r["id"], r["chunk_start"].day, r["chunk_end"].day) for r in rows]
    assert spans == [(1, 1, 3), (1, 4, 6), (1, 7, 8), (2, 5, 5)]
    with pytest.raises(ValueError):
        D.date_chunks(df, "s", "e", 0)


def test_labels(spark):
    assert table(spark, X.label_signal_types, ["probate,tax_delinquent", "lien,mechanics_lien", "odd_type", ""]) == [
        "Probate + tax delinquent", "Lien + lien", "Odd type", ""]
    assert table(spark, X.title_case, ["4412 W GLENROSA AVE", "ACME LLC/SMITH-JONES", "O'NEIL & CO"]) == [
        "4412 W Glenrosa Ave", "Acme LLC/Smith-Jones", "O'Neil & Co"]
    assert table(spark, X.format_situs_address, [
        "1024 E FRYE RD 1100 1100", "5 W MAIN ST", "RURAL ROUTE 5", "7 AVE ST 9 B", "A A A", " ", None]) == [
        "1024 E FRYE RD #1100", "5 W MAIN ST", "RURAL ROUTE 5", "7 AVE ST #9 B", "A", "", None]
    assert table(spark, X.title_case, ["", " a ", None]) == ["", " A ", None]
    assert table(spark, lambda c: X.list_sentence(T.csv_list(c)), ["", "a", "a,b", "a, b,c"]) == [
        "", "a", "a and b", "a, b and c"]
    assert table(spark, X.owner_initials, ["SMITH JOHN A", " x "]) == ["S. J. A.", "X."]
    assert table(spark, X.short_company_name, [
        "Great Flips – Phoenix Wholesale Houses", "A & A Funding Corp", "Acme, Inc.", None]) == [
        "Great Flips", "A & A Funding", "Acme", ""]
    assert table(spark, X.is_bot_user_agent, [None, " ", "Mozilla/5.0", "GoogleBot", "Microsoft Defender x"]) == [
        True, True, False, True, True]


def test_pitch_line(spark):
    df = spark.createDataFrame(
        [("probate,tax_delinquent", "4412 W GLENROSA AVE", "PHOENIX", "85019", 23, True),
         ("lien", None, None, None, None, None)],
        "t string, a string, c string, z string, y int, ab boolean")
    got = [r[0] for r in df.select(X.build_pitch_line("t", "a", "c", "z", "y", "ab")).collect()]
    assert got == [
        "Probate + tax delinquent · 4412 W Glenrosa Ave, Phoenix 85019 · owned 23 yrs · absentee",
        "Lien · (address unresolved) · owner-occupied"]


def test_inbox_and_subjects(spark):
    df = spark.createDataFrame(
        [("Info@acme.com", "acme.com"), ("sales+x@acme.com", None), ("a@b.com", "https://www.b.com/x"),
         ("a@123-sold.com", "b.com"), ("nobody", "b.com"), (None, "b.com"), ("a@b.com", "")],
        "e string, u string")
    got = [r[0] for r in df.select(X.classify_inbox("e", "u")).collect()]
    assert got == ["shared", "shared", None, "third-party", None, None, None]
    subject = lambda v: table(spark, lambda c: X.subject_for(F.lit(v), c, F.lit("12")),
                              ["A & A Funding Corp", "Great Flips", None])
    assert subject("B") == ["12 maricopa filings this week"] * 3
    assert subject("C") == ["A & A Funding's next maricopa seller?"] + ["your next maricopa seller?"] * 2


def test_delivery_errors(spark):
    df = spark.createDataFrame(
        [("EAUTH", 550), (None, 535), (None, 550), ("X", 421), (None, None)], "c string, r int")
    got = [r[0] for r in df.select(X.classify_delivery_error("c", "r")).collect()]
    assert got == ["abort", "abort", "bounce", "abort", "abort"]


def test_millions_are_rounded_as_printf_does(spark):
    """Exact binary values, halves to the even digit: 1.15 is below 1.15, and 2.25 is a half."""
    amounts = [50_000 * i for i in range(20, 400)] + [1_149_999, 1_150_001, 123_456_750_000, 9_999_950_000, 9 * 10 ** 19]
    sql_face.register(spark)
    df = spark.createDataFrame([(float(a),) for a in amounts], "x double")
    got = df.select("x", X.fmt_money("x").alias("a"), F.expr("fmt_money(x)").alias("b")).collect()
    assert [(r["a"], r["b"]) for r in got] == [(f"${r['x'] / 1e6:.1f}m",) * 2 for r in got]
