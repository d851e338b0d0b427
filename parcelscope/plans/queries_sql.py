"""The scalar functions called from plain Spark SQL over the engine's tables.

Each query here is SQL text over registered functions, and has the result of the query of the same name
without `sql_`, so both are held against one DuckDB text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import sql_face
from ..operators import report as R
from ..operators import resolve as V
from . import queries_outreach, queries_report, queries_resolve, queries_text  # noqa: F401  their SQL is shared
from . import sample_tables as S
from .registry import SQL, Tables, query

_TS = f"timestamp'{S.AS_OF}'"
_MAILED = "get(split(mailing_address, ', '), {})"

#: name of the twin, the table it reads, Spark SQL over {t}
TEXTS: dict[str, tuple[str, str]] = {
    # --- text ---
    "normalize_apn": ("pages", "SELECT page_id, normalize_apn(url) AS apn FROM {t}"),
    "normalize_owner_name": ("properties", "SELECT apn, normalize_owner_name(owner_name) AS norm FROM {t}"),
    "normalize_address": ("properties", "SELECT apn, normalize_address(mailing_address) AS norm FROM {t}"),
    "street_only": ("signals", "SELECT source, external_id, street_only(situs_address) AS street FROM {t} WHERE situs_address IS NOT NULL"),
    "address_match_key": ("properties", "SELECT apn, address_match_key(situs_address) AS situs_key, address_match_key(mailing_address) AS mail_key FROM {t}"),
    "zip5": ("properties", "SELECT apn, zip5(mailing_address) AS zip FROM {t}"),
    "absentee_flag": ("properties", f"SELECT apn, absentee_flag({_MAILED.format(0)}, {_MAILED.format(1)}, {_MAILED.format(3)}, "
                      "situs_address, situs_city, situs_zip) AS absentee FROM {t}"),
    "is_entity_owner": ("properties", "SELECT apn, is_entity_owner(owner_name) AS is_entity FROM {t}"),
    "email_domain": ("prospects", "SELECT id, email_domain(email) AS domain FROM {t}"),
    "split_owner_name": ("properties", "SELECT apn, o.first, o.last FROM (SELECT apn, split_owner_name(owner_name, is_entity_owner(owner_name)) AS o FROM {t})"),
    "mailing_fields": ("properties", "SELECT apn, m.* FROM (SELECT apn, mailing_fields(absentee, mailing_address, situs_address, situs_city, situs_zip) AS m FROM {t})"),
    "csv_list": ("prospects", "SELECT id, array_join(csv_list(zips), ';') AS zips, array_join(csv_list(lower(cities)), ';') AS cities FROM {t}"),
    # --- names ---
    "property_keys": ("properties", "SELECT * FROM (SELECT apn, array_join(array_sort(property_keys(owner_name)), ';') AS keys FROM {t}) WHERE keys <> ''"),
    "entity_key": ("properties", "SELECT apn, name_normalize(owner_name) AS name_norm, is_entity_name(owner_name) AS is_entity, "
                   "entity_key(owner_name) AS entity_key FROM {t}"),
    # --- dates ---
    "phoenix_date": ("events", "SELECT event_id, phoenix_date(ts) AS day, b.start AS day_start, b.end AS day_end "
                     "FROM (SELECT event_id, ts, phoenix_day_bounds(ts) AS b FROM {t})"),
    "years_owned": ("properties", f"SELECT apn, years_owned(last_sale_date, {_TS}) AS years_owned FROM {{t}}"),
    "relative_time": ("properties", f"SELECT apn, relative_time(cast(last_sale_date AS TIMESTAMP), {_TS}) AS ago FROM {{t}}"),
    "auction_cell": ("parcel_stats", f"SELECT apn, cast(days_to_auction(est, {_TS}) AS BIGINT) AS days_to_auction, auction_cell(est, {_TS}) AS cell "
                     "FROM (SELECT apn, est_auction_date(trustee_date) AS est FROM {t})"),
    "date_chunks": ("orders", "SELECT o_orderkey, inline(c) FROM (SELECT o_orderkey, date_chunks(to_date(o_orderdate), "
                    "date_add(to_date(o_orderdate), cast(o_orderkey % 14 AS INT)), 3) AS c FROM {t})"),
    "parse_us_date": ("orders", "SELECT o_orderkey, parse_us_date(date_format(o_orderdate, 'M/d/yyyy h:mm:ss a')) AS d FROM {t}"),
    "parse_deed_date": ("orders", "SELECT o_orderkey, parse_deed_date(concat(if(o_orderkey % 3 = 0, '0231', date_format(o_orderdate, 'MMdd')), "
                        "date_format(o_orderdate, 'yyyy'))) AS deed, parse_sale_date(date_format(o_orderdate, 'M yyyy')) AS sale FROM {t}"),
    # --- labels and cells ---
    "title_case": ("properties", "SELECT apn, title_case(owner_name) AS owner, title_case(mailing_address) AS mailing FROM {t}"),
    "format_situs_address": ("properties", "SELECT apn, format_situs_address(situs_address) AS situs FROM {t}"),
    "label_signal_types": ("scores", "SELECT apn, label_signal_types(array_join(signal_types, ',')) AS label FROM {t}"),
    "build_pitch_line": ("resolved_leads", "SELECT apn, build_pitch_line(signal_types, situs_address, situs_city, situs_zip, years_owned, absentee) "
                         "AS pitch_line FROM {t}"),
    "lead_key": ("signals", "SELECT source, external_id, lead_key(apn, owner_name, signal_type, situs_address) AS lead_key FROM {t}"),
    "has_signal_type": ("scores", "SELECT apn, has_signal_type(array_join(signal_types, ','), 'lien') AS has_lien FROM {t}"),
    "money_labels": ("properties", "SELECT apn, money_k(assessed_value) AS money_k, fmt_money(last_sale_price * 3) AS fmt_money FROM {t}"),
    "score_band": ("scores", "SELECT apn, score_band(score) AS band, score_pct(score) AS pct FROM {t}"),
    "list_sentence": ("scores", "SELECT apn, list_sentence(signal_types) AS sentence, short_date(components.latest_date) AS newest FROM {t}"),
    "signal_type_labels": ("signals", "SELECT signal_type, n, is_urgent(signal_type) AS urgent, provenance_verb(signal_type) AS verb, "
                           "plural_label(signal_type) AS plural FROM (SELECT signal_type, count(*) AS n FROM {t} GROUP BY signal_type)"),
    "newest_external_id": ("provenance", f"SELECT apn, newest_external_id(signals, array({', '.join(repr(x) for x in K.RECORDER_TYPES)})) AS doc, "
                           "source_urls_joined(signals) AS urls FROM {t}"),
    # --- outreach ---
    "short_company_name": ("prospects", "SELECT id, short_company_name(company) AS short, first_name(contact_name) AS first FROM {t}"),
    "subject_for": ("prospects", "SELECT id, variant, subject_for(variant, company, id * 7) AS subject "
                    "FROM (SELECT id, company, explode(array('A', 'B', 'C', 'D', 'E', NULL)) AS variant FROM {t})"),
    "classify_inbox": ("prospects", "SELECT id, classify_inbox(email, url) AS inbox_flag FROM {t}"),
    "classify_delivery_error": ("events", "SELECT event_id, classify_delivery_error(if(event_id % 4 = 0, 'ETIMEDOUT', 'EENVELOPE'), "
                                "cast(event_id % 120 + 500 AS INT)) AS verdict FROM {t}"),
    "is_bot_user_agent": ("documents", "SELECT doc_id, is_bot_user_agent(CASE WHEN n_chars % 7 = 0 THEN ' ' "
                          "WHEN n_chars % 5 = 0 THEN concat(text, ' GoogleBot/2') ELSE text END) AS bot FROM {t}"),
}

_RAW = {"pages", "orders", "documents"}


def _table(t: Tables, name: str):
    if name in _RAW:
        return t.raw(name)
    if name == "events":
        return S.read(t.spark, t.dir, "events")
    if name == "parcel_stats":
        return R.apn_stats(t.signals)
    if name == "resolved_leads":
        return R.resolved_leads_only(R.report_all(t.signals, t.properties, t.scores, t.as_of, 720))
    if name == "provenance":
        rows = R.provenance_top6(R.latest_signal_per_type(t.signals))
        return rows.select("apn", F.transform("signals", lambda s: F.struct(s["type"].alias("type"), s["external_id"].alias("external_id"),
                                                                            s["source_url"].alias("source_url"))).alias("signals"))
    return getattr(t, name)


for _name, (_source, _text) in TEXTS.items():

    @query(f"sql_{_name}", SQL[_name])
    def _(t: Tables, source=_source, text=_text):
        sql_face.ensure(t.spark)
        return t.spark.sql(text, t=_table(t, source))


@query("sql_signal_keys", SQL["signal_keys"])
def _(t: Tables):
    sql_face.ensure(t.spark)
    names = V.name_lookups(t.signals).select("owner_name")
    return t.spark.sql("""
      SELECT owner_name, array_join(keys, ';') AS keys FROM (
        SELECT owner_name, CASE WHEN is_entity_name(owner_name) THEN array_compact(array(entity_key(owner_name)))
          ELSE signal_keys(owner_name) END AS keys FROM {t}) WHERE size(keys) > 0""", t=names)
