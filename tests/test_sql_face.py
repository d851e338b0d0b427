import datetime as dt

import pytest
from pyspark.sql import functions as F

from parcelscope.functions import dates as D
from parcelscope.functions import display as X
from parcelscope.functions import names as N
from parcelscope.functions import sql_face
from parcelscope.functions import text as T

TEXTS = [
    None, "", "  ", "SMITH JOHN A & MARY", "Smith, J. L.L.C.", "123 n. Main St apt 5 PHOENIX", "12 E VW RD #4", "THE BIG CO", "5 OAK AVE 7 7",
    "O'BRIEN-LEE ii", "02 2019", "2 1999", "13 2000", "01022003", "02312005", "1/2/2020 rest", "1.5e3", "0", "-4", "1e999", "1987", "87",
    "55% 2.R; 45%", "a@B.com", "info+x@site.org", "probate,tax_delinquent, odd_type ,probate", "divorce", "trustee_sale", "Acme Homes, Inc.",
    "Bill's Group LLC", "Lone – Star", "Googlebot/2", "Mozilla/5.0", "85001-1234", "JONES MARY\tB / BOB", "unknown", "ESTATE OF X Y", "n/a",
    "A\u00a0", "X" * 40, "www.site.org", "https://www.Site.org/a", "FIRST BANK", "JONES", "J", "&", "B/A AND C D 12", "1 ELM ST ST", "CT", "ÉTÉ rue",
]
DAYS = [None, dt.date(2024, 1, 1), dt.date(2023, 12, 31), dt.date(2020, 2, 29), dt.date(2024, 1, 31), dt.date(2024, 3, 1)]
AS_OF = "2024-01-31 06:30:00"

ONE_TEXT = {
    **{n: getattr(T, n) for n in (
        "blank_to_null", "normalize_apn", "normalize_owner_name", "normalize_address", "street_only", "sorted_name_key", "address_match_key",
        "zip5", "parse_legal_class", "numeric_or_null", "year_built", "csv_list", "is_entity_owner", "is_institution", "email_domain")},
    **{n: getattr(D, n) for n in ("parse_us_date", "parse_deed_date", "parse_sale_date")},
    **{n: getattr(N, n) for n in ("name_normalize", "is_entity_name", "persons_from_owner", "property_keys", "signal_keys", "entity_key")},
    **{n: getattr(X, n) for n in (
        "title_case", "format_situs_address", "label_signal_types", "owner_initials", "is_urgent", "provenance_verb", "plural_label",
        "short_company_name", "first_name", "is_bot_user_agent", "is_role_inbox", "site_domain")},
    "person_tokens": lambda c: N.person_tokens(F.col(c)), "strip_ends": T.strip, "squeeze": lambda c: T.squeeze(F.col(c)),
    "split_words": lambda c: T.split_words(F.col(c)),
}
def pairs():
    """SQL and Column; a and b are texts, d a day, n a number, f a flag."""
    return {
        "same_street_address(a, b, a, b, a, b)": T.same_street_address("a", "b", "a", "b", "a", "b"),
        "same_street_address(a, b, 'x', a, '', b)": T.same_street_address("a", "b", F.lit("x"), "a", F.lit(""), "b"),
        "absentee_flag(a, a, a, b, b, b)": T.absentee_flag("a", "a", "a", "b", "b", "b"),
        "compose_mailing_address(a, b, a, NULL, b)": T.compose_mailing_address("a", "b", "a", F.lit(None), "b"),
        "compose_situs_address(a, b)": T.compose_situs_address("a", "b"),
        "pick_document_owner(array(a, b))": T.pick_document_owner(F.array("a", "b")),
        "list_sentence(array(a, b, 'x'))": X.list_sentence(F.array("a", "b", F.lit("x"))),
        "list_sentence(split_words(a))": X.list_sentence(T.split_words(F.col("a"))),
        "has_signal_type(a, 'probate')": X.has_signal_type("a", "probate"),
        "lead_key(a, b, a, b)": X.lead_key("a", "b", "a", "b"),
        "build_pitch_line(a, b, a, b, n, f)": X.build_pitch_line("a", "b", "a", "b", "n", "f"),
        "split_owner_name(a, f)": X.split_owner_name("a", "f"),
        "mailing_fields(f, a, b, a, b)": X.mailing_fields("f", "a", "b", "a", "b"),
        "owner_initials_mask(a, b, f)": X.owner_initials_mask("a", "b", "f"),
        "subject_for('C', a, 5)": X.subject_for(F.lit("C"), "a", F.lit(5)),
        "subject_for(left(b, 1), a, n)": X.subject_for(F.left("b", F.lit(1)), "a", "n"),
        "is_third_party_domain(a, b)": X.is_third_party_domain("a", "b"),
        "classify_inbox(a, b)": X.classify_inbox("a", "b"),
        "classify_delivery_error(a, n)": X.classify_delivery_error("a", "n"),
        "classify_delivery_error('EAUTH', n)": X.classify_delivery_error(F.lit("EAUTH"), "n"),
        "score_band(n)": X.score_band("n"), "score_pct(n)": X.score_pct("n"),
        "money_k(n)": X.money_k("n"), "fmt_money(n * 3000)": X.fmt_money(F.col("n") * 3000),
        f"age_in_days(d, timestamp'{AS_OF}')": D.age_in_days("d", AS_OF), f"years_owned(d, timestamp'{AS_OF}')": D.years_owned("d", AS_OF),
        "est_auction_date(d)": D.est_auction_date("d"), f"days_to_auction(d, timestamp'{AS_OF}')": D.days_to_auction("d", AS_OF),
        f"auction_cell(d, timestamp'{AS_OF}')": D.auction_cell("d", AS_OF), "short_date(d)": D.short_date("d"),
        f"relative_time(cast(d as timestamp), timestamp'{AS_OF}')": D.relative_time("d", AS_OF),
        "phoenix_date(cast(d as timestamp))": D.phoenix_date(F.col("d").cast("timestamp")),
        "phoenix_day_bounds(cast(d as timestamp))": D.phoenix_day_bounds(F.col("d").cast("timestamp")),
        "newest_external_id(array(struct(a as type, b as external_id, a as source_url)), array('divorce', 'J'))":
            X.newest_external_id(F.array(F.struct(F.col("a").alias("type"), F.col("b").alias("external_id"), F.col("a").alias("source_url"))), ["divorce", "J"]),
        "source_urls_joined(array(struct(a as type, b as external_id, a as source_url), struct(a as type, b as external_id, b as source_url)))":
            X.source_urls_joined(F.array(F.struct(F.col("a").alias("source_url")), F.struct(F.col("b").alias("source_url")))),
    }


@pytest.fixture(scope="module")
def table(spark):
    sql_face.register(spark)
    rows = [(i, t, TEXTS[(i * 7 + 3) % len(TEXTS)], DAYS[i % len(DAYS)], (None, 0, 35, 79, 160, 530, 550, 421)[i % 8], (None, True, False)[i % 3])
            for i, t in enumerate(TEXTS)]
    rows += [(i + 100, t, t, None, 999, False) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "i int, a string, b string, d date, n int, f boolean")
    df.createOrReplaceTempView("awkward")
    return df


def same(spark, table, calls):
    sql = spark.sql("SELECT i, " + ", ".join(f"{s} AS c{k}" for k, (s, _) in enumerate(calls)) + " FROM awkward").orderBy("i").collect()
    own = table.select("i", *[c.alias(f"c{k}") for k, (_, c) in enumerate(calls)]).orderBy("i").collect()
    inputs = {r["i"]: r for r in table.collect()}
    for a, b in zip(sql, own):
        for k, (name, _) in enumerate(calls):
            assert a[f"c{k}"] == b[f"c{k}"], (name, inputs[a["i"]])


def test_functions_of_one_text(spark, table):
    same(spark, table, [(f"{n}(a)", fn("a")) for n, fn in ONE_TEXT.items()])


def test_functions_of_several_values(spark, table):
    same(spark, table, list(pairs().items()))


def test_date_chunks(spark, table):
    ranges = table.selectExpr("i", "d AS first", "date_add(d, i % 40 - 2) AS last")
    ranges.createOrReplaceTempView("ranges")
    sql = spark.sql("SELECT i, first, last, inline(c) FROM (SELECT *, date_chunks(first, last, 9) AS c FROM ranges)")
    assert sorted(map(tuple, sql.collect())) == sorted(map(tuple, D.date_chunks(ranges, "first", "last", 9).collect()))


def test_calls_are_replaced_by_their_bodies(spark, table):
    every = ", ".join(f"{n}(a)" for n in ONE_TEXT)
    plan = spark.sql(f"SELECT {every} FROM awkward WHERE normalize_apn(b) = 'X'")._jdf.queryExecution().toString()
    assert "Python" not in plan and "UserDefined" not in plan and "regexp_replace(upper(coalesce(b" in plan


def test_every_listed_function_is_tested_and_prefix_works(spark, table):
    tested = set(ONE_TEXT) | {s.split("(")[0] for s in pairs()} | {"date_chunks"}
    bodies = " ".join(f[3] for f in sql_face.FUNCTIONS)
    helpers = {n for n in sql_face.NAMES if f"{n}(" in bodies}
    assert set(sql_face.NAMES) - tested <= helpers
    names = sql_face.register(spark, "ps_")
    assert spark.sql("SELECT ps_street_only('1 Elm St, Mesa') s").first()["s"] == "1 ELM ST MESA" or names
