"""Scores, reports, leads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import display as X
from ..operators import layout
from ..operators import leads as L
from ..operators import report as R
from ..operators import score as S
from .oracle_tables import (
    AS_OF, FILED_14D, PHX_TODAY, REPORT_ORDER, TODAY, case_of, report_sql,
)
from .registry import SQL, Tables, query


def r6(name: str):
    return F.round(name, 6).alias(name)


# --- scoring -----------------------------------------------------------------------------------


@query("latest_per_type", "SELECT apn, signal_type, latest_date FROM latest_types")
def _(t: Tables):
    return S.latest_per_type(t.signals)


@query("type_signals_rollup", """
  SELECT apn, count(*) AS n, string_agg(signal_type || '@' || latest_date::VARCHAR, ',' ORDER BY signal_type) AS types
  FROM latest_types GROUP BY apn""")
def _(t: Tables):
    rolled = S.type_signals_rollup(S.latest_per_type(t.signals))
    text = F.transform("type_signals", lambda e: F.concat_ws("@", e["type"], e["date"].cast("string")))
    return rolled.select(
        "apn", F.size("type_signals").cast("bigint").alias("n"), F.array_join(text, ",").alias("types")
    )


@query("score_join", """
  SELECT l.apn, count(*) AS n, any_value(p.absentee) AS absentee,
    any_value(p.last_sale_date) AS last_sale_date, round(any_value(p.assessed_value), 6) AS assessed_value
  FROM latest_types l JOIN properties p USING (apn) GROUP BY 1""")
def _(t: Tables):
    joined = S.score_join(S.type_signals_rollup(S.latest_per_type(t.signals)), t.properties)
    return joined.select(
        "apn", F.size("type_signals").cast("bigint").alias("n"), "absentee", "last_sale_date",
        r6("assessed_value"),
    )


def _laid_out(t: Tables):
    """Signals with a parcel number, the others, properties and scores, the keyed ones bucketed by it."""
    buckets = layout.buckets_for(t.raw("events").count())
    signals, rest = layout.by_parcel(t.signals, "signals", buckets)
    return signals, rest, layout.bucketed(t.properties, "properties", buckets=buckets), layout.bucketed(t.scores, "scores", buckets=buckets)


@query("score_join_bucketed", SQL["score_join"])
def _(t: Tables):
    signals, _, properties, _ = _laid_out(t)
    joined = S.score_join(S.type_signals_rollup(S.latest_per_type(signals)), properties)
    return joined.select(
        "apn", F.size("type_signals").cast("bigint").alias("n"), "absentee", "last_sale_date",
        r6("assessed_value"),
    )


@query("score_type_terms", """
  SELECT apn, signal_type, latest_date, base, age_days, round(decayed, 6) AS decayed, live, bonus
  FROM type_terms""")
def _(t: Tables):
    return S.type_terms(S.latest_per_type(t.signals), t.as_of).select(
        "apn", "signal_type", "latest_date", "base", "age_days", r6("decayed"), "live", "bonus"
    )


@query("score_parcels", """
  SELECT apn, score, hot, types, live_count, fresh, absentee, high_equity, long_tenure, latest_date
  FROM scores""")
def _(t: Tables):
    b, c = "breakdown.", "components."
    return t.scores.select(
        "apn", "score", "hot", F.array_join("signal_types", ",").alias("types"),
        b + "live_count", b + "fresh", c + "modifiers.absentee", c + "modifiers.high_equity",
        c + "modifiers.long_tenure", c + "latest_date",
    )


@query("score_breakdown", """
  SELECT x.apn, x.signal_type, x.base, x.age_days, round(x.decayed, 6) AS decayed, x.live,
         s.days_out AS auction_days_out, s.bonus AS auction_bonus
  FROM type_terms x JOIN scores USING (apn)
  LEFT JOIN type_terms s ON s.apn = x.apn AND s.signal_type = 'trustee_sale'""")
def _(t: Tables):
    rows = t.scores.select(
        "apn", F.explode("breakdown.types").alias("signal_type", "d"),
        F.col("breakdown.auction.days_out").alias("auction_days_out"),
        F.col("breakdown.auction.bonus").alias("auction_bonus"),
    )
    return rows.select(
        "apn", "signal_type", "d.base", "d.age_days", F.round("d.decayed", 6).alias("decayed"),
        "d.live", "auction_days_out", "auction_bonus",
    )


@query("auction_info", """
  SELECT apn, latest_date + 90 AS est_date, days_out, bonus, days_out < 0 AS passed
  FROM type_terms WHERE signal_type = 'trustee_sale'""")
def _(t: Tables):
    trustee = S.latest_per_type(t.signals.where(F.col("signal_type") == "trustee_sale"))
    return trustee.select("apn", S.auction_info("latest_date", t.as_of).alias("a")).select("apn", "a.*")


@query("equity_tenure_flags", f"""
  SELECT apn, assessed_value IS NOT NULL AND coalesce(last_sale_date < {AS_OF} - INTERVAL 10 YEAR, true)
           AS high_equity,
         coalesce(last_sale_date < {AS_OF} - INTERVAL 15 YEAR, true) AS long_tenure
  FROM properties""")
def _(t: Tables):
    flags = S.equity_tenure_flags("last_sale_date", "assessed_value", t.as_of)
    return t.properties.select("apn", flags.alias("f")).select("apn", "f.*")


@query("score_components", """
  SELECT apn, types, absentee::INT || '/' || high_equity::INT || '/' || long_tenure::INT AS modifiers,
         fresh, latest_date FROM scores""")
def _(t: Tables):
    m = [F.col(f"components.modifiers.{x}").cast("int").cast("string")
         for x in ("absentee", "high_equity", "long_tenure")]
    return t.scores.select(
        "apn", F.array_join("components.types", ",").alias("types"),
        F.concat_ws("/", *m).alias("modifiers"), "components.fresh", "components.latest_date",
    )


@query("score_distribution", """
  SELECT CASE WHEN score <= 25 THEN '0-25' WHEN score <= 50 THEN '26-50' WHEN score <= 75 THEN '51-75'
         ELSE '76+' END AS bucket, count(*) AS n, count_if(hot) AS n_hot FROM scores GROUP BY 1""")
def _(t: Tables):
    return S.score_distribution(t.scores)


@query("top5_scores", "SELECT apn, score, hot, types FROM scores ORDER BY score DESC, apn LIMIT 5")
def _(t: Tables):
    return S.top5_scores(t.scores)


@query("score_breakdown_v1", f"""
  SELECT apn, string_agg(label || '=' || points, ';' ORDER BY ord) AS breakdown FROM (
    SELECT apn, list_position(string_split(types, ','), ty) AS ord,
           {case_of('ty', {k: v[0] for k, v in K.STATIC_TYPE_POINTS.items()})} AS label,
           {case_of('ty', {k: v[1] for k, v in K.STATIC_TYPE_POINTS.items()})} AS points
    FROM (SELECT apn, types, unnest(string_split(types, ',')) AS ty FROM scores)
    UNION ALL
    SELECT apn, 101, 'Signal stacking', 15 * (len(string_split(types, ',')) - 1) FROM scores
    WHERE types LIKE '%,%'
    UNION ALL SELECT apn, 102, 'Absentee', 10 FROM scores WHERE absentee
    UNION ALL SELECT apn, 103, 'High Equity', 10 FROM scores WHERE high_equity
    UNION ALL SELECT apn, 104, 'Long Tenure', 5 FROM scores WHERE long_tenure
    UNION ALL SELECT apn, 105, 'Fresh (last 30 days)', 10 FROM scores WHERE fresh)
  WHERE label IS NOT NULL GROUP BY apn""")
def _(t: Tables):
    text = F.transform(
        S.score_breakdown_v1("components"),
        lambda e: F.concat_ws("=", e["label"], e["points"].cast("string")),
    )
    rows = t.scores.select("apn", F.array_join(text, ";").alias("breakdown"))
    return rows.where(F.col("breakdown") != "")


# --- report ------------------------------------------------------------------------------------


@query("arrival_window", f"""
  SELECT source, external_id, created_at FROM signals WHERE created_at > {AS_OF} - INTERVAL 72 HOUR""")
def _(t: Tables):
    return R.arrival_window(t.signals, t.as_of, 72).select("source", "external_id", "created_at")


@query("filed_window_days", f"""
  SELECT source, external_id, event_date FROM signals WHERE event_date >= {PHX_TODAY} - 14""")
def _(t: Tables):
    return R.filed_window_days(t.signals, t.as_of, 14).select("source", "external_id", "event_date")


@query("filed_window_hours", f"""
  SELECT source, external_id, event_date FROM signals
  WHERE event_date >= ({AS_OF} - INTERVAL 48 HOUR)::DATE""")
def _(t: Tables):
    return R.filed_window_hours(t.signals, t.as_of, 48).select("source", "external_id", "event_date")


@query("resolve_window_option", f"""
  SELECT 'unknown' AS arrival, 'any' AS filed, count(*) AS n FROM signals
    WHERE created_at > {AS_OF} - INTERVAL 168 HOUR
  UNION ALL SELECT '48', '14d', count(*) FROM signals
    WHERE created_at > {AS_OF} - INTERVAL 48 HOUR AND event_date >= {PHX_TODAY} - 14
  UNION ALL SELECT '24h', '48', count(*) FROM signals
    WHERE created_at > {AS_OF} - INTERVAL 24 HOUR AND event_date >= {PHX_TODAY} - 2""")
def _(t: Tables):
    parts = []
    for arrival, filed in (("unknown", "any"), ("48", "14d"), ("24h", "48")):
        rows = R.arrival_window(t.signals, t.as_of, R.resolve_window_option(arrival))
        rows = R.filed_window_days(rows, t.as_of, R.resolve_filed_option(filed))
        parts.append(rows.agg(F.count("*").alias("n")).select(
            F.lit(arrival).alias("arrival"), F.lit(filed).alias("filed"), "n"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


DEDUPED = ["apn", "signal_type", "source", "external_id", "event_date", "owner_name", "created_at"]
_NEWEST = "ORDER BY event_date DESC NULLS LAST, created_at DESC, source, external_id"


@query("dedupe_resolved", f"""
  SELECT {', '.join(DEDUPED)} FROM signals WHERE apn IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY apn {_NEWEST}) = 1""")
def _(t: Tables):
    return R.dedupe_resolved(t.signals).select(*DEDUPED)


@query("dedupe_unresolved", f"""
  SELECT {', '.join(DEDUPED)} FROM signals WHERE apn IS NULL
  QUALIFY row_number() OVER (PARTITION BY owner_name, signal_type {_NEWEST}) = 1""")
def _(t: Tables):
    return R.dedupe_unresolved(t.signals).select(*DEDUPED)


@query("combine_resolved_unresolved", f"""
  SELECT {', '.join(DEDUPED)} FROM signals
  QUALIFY row_number() OVER (PARTITION BY apn, CASE WHEN apn IS NULL THEN owner_name END,
    CASE WHEN apn IS NULL THEN signal_type END {_NEWEST}) = 1""")
def _(t: Tables):
    return R.combine_resolved_unresolved(
        R.dedupe_resolved(t.signals), R.dedupe_unresolved(t.signals)
    ).select(*DEDUPED)


@query("distinct_apns", "SELECT apn FROM signals WHERE apn IS NOT NULL GROUP BY apn")
def _(t: Tables):
    return R.distinct_apns(t.signals)


@query("apn_semi_reduce", f"""
  SELECT source, external_id, apn FROM signals WHERE apn IN (
    SELECT apn FROM signals WHERE created_at > {AS_OF} - INTERVAL 24 HOUR)""")
def _(t: Tables):
    apns = R.distinct_apns(R.arrival_window(t.signals, t.as_of, 24))
    return R.apn_semi_reduce(t.signals, apns).select("source", "external_id", "apn")


@query("apn_semi_reduce_bucketed", SQL["apn_semi_reduce"])
def _(t: Tables):
    signals, *_ = _laid_out(t)
    apns = R.distinct_apns(R.arrival_window(signals, t.as_of, 24))
    return R.apn_semi_reduce(signals, apns).select("source", "external_id", "apn")


@query("apn_stats", "SELECT apn, stacked_types, signal_types, trustee_date FROM parcel_types")
def _(t: Tables):
    return R.apn_stats(t.signals)


@query("latest_signal_per_type", f"""
  SELECT {', '.join(DEDUPED)} FROM signals WHERE apn IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY apn, signal_type {_NEWEST}) = 1""")
def _(t: Tables):
    return R.latest_signal_per_type(t.signals).select(*DEDUPED)


_PROVENANCE = f"""
  SELECT apn, string_agg(signal_type || ':' || external_id, ',' ORDER BY rn) AS entries FROM (
    SELECT *, row_number() OVER (PARTITION BY apn {_NEWEST}) AS rn FROM (
      SELECT * FROM signals WHERE apn IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY apn, signal_type {_NEWEST}) = 1))
  WHERE rn <= 6 GROUP BY apn"""


def _entries(column="signals"):
    return F.array_join(
        F.transform(column, lambda s: F.concat_ws(":", s["type"], s["external_id"])), ","
    ).alias("entries")


@query("provenance_top6", _PROVENANCE)
def _(t: Tables):
    return R.provenance_top6(R.latest_signal_per_type(t.signals)).select("apn", _entries())


_OUT = ", ".join(c for c in R.REPORT_COLUMNS if c not in ("assessed_value", "last_sale_price"))


def _report_sql(hours, filed, limit, extra="", homeowners=True):
    return f"""SELECT {_OUT}, round(assessed_value, 6) AS assessed_value,
        round(last_sale_price, 6) AS last_sale_price {extra}
      FROM ({report_sql(hours, filed, homeowners)}) ORDER BY {REPORT_ORDER} LIMIT {limit}"""


def _shown(df, *extra):
    cols = [r6(c) if c in ("assessed_value", "last_sale_price") else c for c in R.REPORT_COLUMNS]
    return df.select(*cols, *extra)


@query("daily_report", _report_sql(24, FILED_14D, 50))
def _(t: Tables):
    return _shown(t.report(24, 50))


@query("daily_report_week", _report_sql(168, FILED_14D, 400))
def _(t: Tables):
    return _shown(t.report(168, 400))


@query("daily_report_all_owners", _report_sql(168, "true", 400, homeowners=False))
def _(t: Tables):
    return _shown(t.report(168, 400, homeowners=False, filed_days=None))


@query("report_enrich", f"""SELECT {_OUT}, round(assessed_value, 6) AS assessed_value,
    round(last_sale_price, 6) AS last_sale_price
  FROM ({report_sql(720, 'true', False)})""")
def _(t: Tables):
    fresh = R.arrival_window(t.signals, t.as_of, 720)
    return _shown(R.report_enrich(
        R.dedupe_resolved(fresh), R.dedupe_unresolved(fresh), t.signals, t.properties, t.scores,
        t.as_of,
    ))


@query("report_enrich_bucketed", SQL["report_enrich"])
def _(t: Tables):
    signals, rest, properties, scores = _laid_out(t)
    return _shown(R.report_enrich(
        R.dedupe_resolved_in_buckets(R.arrival_window(signals, t.as_of, 720)), R.dedupe_unresolved(R.arrival_window(rest, t.as_of, 720)),
        signals, properties, scores, t.as_of,
    ))


@query("homeowners_only", f"""
  SELECT apn, owner_name, is_entity FROM ({report_sql(720, 'true', False)})
  WHERE owner_name IS NOT NULL AND NOT is_entity""")
def _(t: Tables):
    fresh = R.arrival_window(t.signals, t.as_of, 720)
    rows = R.report_enrich(
        R.dedupe_resolved(fresh), R.dedupe_unresolved(fresh), t.signals, t.properties, t.scores,
        t.as_of,
    )
    return R.homeowners_only(rows).select("apn", "owner_name", "is_entity")


@query("web_report", f"""
  SELECT r.*, coalesce(e.entries, r.signal_type || ':' || r.external_id) AS entries FROM (
    {_report_sql(168, f"event_date >= ({AS_OF} - INTERVAL 336 HOUR)::DATE", 400, ", created_at AS first_seen, external_id")}) r
  LEFT JOIN ({_PROVENANCE}) e ON e.apn = r.apn""".replace("SELECT r.*", "SELECT r.* EXCLUDE (external_id)"))
def _(t: Tables):
    rows = R.web_report(t.signals, t.properties, t.scores, t.as_of, 168, 400, filed_hours=336)
    return _shown(rows, "first_seen", _entries())


_COUNTS = f"""
  SELECT signal_type, count_if(coalesce(event_date >= {PHX_TODAY} - 14, false)) AS n,
    count_if(NOT coalesce(event_date >= {PHX_TODAY} - 14, false)) AS older_n,
    max(event_date) FILTER (event_date >= {PHX_TODAY} - 14) AS freshest
  FROM ({report_sql(72)}) GROUP BY signal_type"""


def _counts(t: Tables):
    return R.report_counts(t.signals, t.properties, t.as_of, 72)


@query("report_counts", _COUNTS)
def _(t: Tables):
    return _counts(t)


@query("report_totals", f"SELECT sum(n)::BIGINT AS n, sum(older_n)::BIGINT AS older_n FROM ({_COUNTS})")
def _(t: Tables):
    return R.report_totals(_counts(t))


@query("freshest_top3", f"""
  SELECT * FROM ({_COUNTS}) WHERE n > 0 AND freshest IS NOT NULL ORDER BY n DESC, signal_type LIMIT 3""")
def _(t: Tables):
    return R.freshest_top3(_counts(t))


@query("report_numbers", f"""
  SELECT (SELECT least(count(*), 5000) FROM ({report_sql(24)})) AS n24, count(*) AS n7,
    count_if(stacked_types >= 2) AS stacked,
    count_if(list_contains(string_split(signal_types, ','), 'trustee_sale')
             AND coalesce(years_owned, 0) >= 10) AS long_trustee
  FROM (SELECT * FROM ({report_sql(168, f"event_date >= ({AS_OF} - INTERVAL 336 HOUR)::DATE")})
        ORDER BY {REPORT_ORDER} LIMIT 5000)""")
def _(t: Tables):
    return R.report_numbers(t.signals, t.properties, t.scores, t.as_of, limit=5000)


@query("hot_stacks", f"""SELECT {_OUT}, round(assessed_value, 6) AS assessed_value,
    round(last_sale_price, 6) AS last_sale_price
  FROM ({report_sql(168)}) WHERE stacked_types >= 2 AND apn IS NOT NULL AND situs_address IS NOT NULL
  ORDER BY {REPORT_ORDER} LIMIT 3""")
def _(t: Tables):
    return _shown(R.hot_stacks(t.signals, t.properties, t.scores, t.as_of))


@query("resolved_leads_only", f"""
  SELECT apn, situs_address FROM ({_report_sql(168, FILED_14D, 400)})
  WHERE apn <> '' AND situs_address <> ''""")
def _(t: Tables):
    return R.resolved_leads_only(t.report(168, 400)).select("apn", "situs_address")


@query("owner_initials_mask", f"""
  SELECT apn, signal_types, is_entity, CASE WHEN regexp_matches(signal_types, '\\b(probate|divorce)\\b') AND NOT is_entity
    THEN array_to_string(list_transform(string_split_regex(trim(owner_name), '\\s+'),
         lambda w: upper(w[1]) || '.'), ' ') ELSE owner_name END AS owner_name
  FROM (SELECT * FROM ({report_sql(168, FILED_14D)}) ORDER BY {REPORT_ORDER} LIMIT 10)""")
def _(t: Tables):
    return R.masked_report(t.report(168, 50)).select("apn", "signal_types", "is_entity", "owner_name")


@query("fresh_vs_backfill", f"""
  SELECT source, external_id, CASE WHEN event_date >= {PHX_TODAY} - 14 THEN 'fresh' ELSE 'backfill' END AS filing
  FROM signals""")
def _(t: Tables):
    return R.fresh_vs_backfill(t.signals, t.as_of).select("source", "external_id", "filing")


# --- leads -------------------------------------------------------------------------------------

_LEAD_COLS = "coalesce(owner_name, '') AS owner_name, coalesce(situs_address, '') AS situs_address, " \
    "coalesce(situs_city, '') AS situs_city, coalesce(mailing_address, '') AS mailing_address"


@query("top_leads", f"""
  SELECT s.apn, score, hot, types AS signal_types, {_LEAD_COLS},
    coalesce(p.absentee, false) AS absentee, s.latest_date
  FROM scores s JOIN properties p USING (apn)
  WHERE hot AND score >= 60 AND situs_city ILIKE '%e%' ORDER BY score DESC, s.apn LIMIT 25""")
def _(t: Tables):
    rows = L.top_leads(t.scores, t.properties, 25, city="E", min_score=60, hot_only=True)
    return rows.withColumns({
        "signal_types": F.array_join("signal_types", ","),
        "latest_date": F.col("components.latest_date"),
    }).drop("components")


_ACTIONS = f"""(SELECT lpad(c_custkey::VARCHAR, 10, '0') AS apn,
    CASE WHEN c_custkey % 5 = 0 THEN 'saved' ELSE 'hidden' END AS action FROM customer
    WHERE c_custkey % 5 < 2)"""


@query("lead_list", f"""
  SELECT s.apn, score, hot, EXISTS (SELECT 1 FROM {_ACTIONS} a WHERE a.apn = s.apn AND action = 'saved') AS saved,
    types AS signal_types, owner_name, situs_address, situs_city, mailing_address,
    coalesce(p.absentee, false) AS absentee, s.latest_date
  FROM scores s JOIN properties p USING (apn)
  WHERE s.apn NOT IN (SELECT apn FROM {_ACTIONS} a WHERE action = 'hidden')
  ORDER BY score DESC, s.apn LIMIT 50""")
def _(t: Tables):
    return L.lead_list(t.scores, t.properties, t.lead_actions).drop("score_breakdown").withColumn(
        "signal_types", F.array_join("signal_types", ",")
    )


@query("lead_list_saved", f"""
  SELECT s.apn, score, true AS saved FROM scores s JOIN properties p USING (apn)
  WHERE s.apn IN (SELECT apn FROM {_ACTIONS} a WHERE action = 'saved')
  ORDER BY score DESC, s.apn LIMIT 50""")
def _(t: Tables):
    rows = L.lead_list(t.scores, t.properties, t.lead_actions, include_hidden=True, saved_only=True)
    return rows.select("apn", "score", "saved")


@query("lead_signals_attach", """
  SELECT apn, score, signal_type, source, external_id, event_date, observed_date
  FROM signals JOIN (SELECT apn, score FROM scores ORDER BY score DESC, apn LIMIT 25) USING (apn)""")
def _(t: Tables):
    best = t.scores.select("apn", "score").orderBy(F.col("score").desc(), "apn").limit(25)
    return L.lead_signals_attach(best, t.signals)


@query("fresh_in_scored", f"""
  SELECT DISTINCT apn FROM signals WHERE event_date >= {TODAY} - 7 AND apn IN (SELECT apn FROM scores)""")
def _(t: Tables):
    return L.fresh_in_scored(t.signals, t.scores, t.as_of, 7)


@query("summary_counts", f"""
  SELECT (SELECT count(*) FROM scores) AS scored, (SELECT count_if(hot) FROM scores) AS hot,
    count(DISTINCT apn) FILTER (event_date >= {TODAY} - 7) AS fresh_7,
    count(DISTINCT apn) FILTER (event_date >= {TODAY} - 30) AS fresh_30
  FROM signals WHERE apn IN (SELECT apn FROM scores)""")
def _(t: Tables):
    return L.summary_counts(t.scores, t.signals, t.as_of)


_BY_SIGNAL = "SELECT unnest(string_split(types, ',')) AS signal_type, count(*) AS n FROM scores GROUP BY 1"


@query("summary_by_signal", _BY_SIGNAL)
def _(t: Tables):
    return t.by_signal


@query("signal_share", f"""
  SELECT signal_type, n, round(n / sum(n) OVER (), 6) AS share FROM ({_BY_SIGNAL})""")
def _(t: Tables):
    return L.signal_share(t.by_signal).withColumn("share", F.round("share", 6))


@query("summary_top_cities", """
  SELECT situs_city AS city, count(*) AS n FROM scores JOIN properties USING (apn)
  WHERE situs_city IS NOT NULL GROUP BY 1 ORDER BY n DESC, city LIMIT 8""")
def _(t: Tables):
    return L.summary_top_cities(t.scores, t.properties)


def _centroid(i: int) -> str:
    arms = {c: p[i] for c, p in K.CITY_CENTROIDS.items()}
    key = "regexp_replace(lower(coalesce(situs_city, '')), '\\s+', '', 'g')"
    return case_of(key, arms, str(K.DEFAULT_CENTROID[i]))


@query("city_centroid_fallback", f"""
  SELECT apn, round({_centroid(0)} + (('0x' || md5(apn)[1:8])::BIGINT / 4294967296.0 - 0.5) * 0.04, 6) AS lat,
         round({_centroid(1)} + (('0x' || md5(apn)[9:16])::BIGINT / 4294967296.0 - 0.5) * 0.04, 6) AS lon
  FROM properties""")
def _(t: Tables):
    rows = L.city_centroid_fallback(t.properties.select("apn", "situs_city"))
    return rows.select("apn", r6("lat"), r6("lon"))


@query("signal_type_labels", f"""
  SELECT signal_type, count(*) AS n, signal_type IN ('trustee_sale', 'lis_pendens', 'probate', 'divorce') AS urgent,
    {case_of('signal_type', K.PROVENANCE_VERBS, "'Recorded'")} AS verb,
    {case_of('signal_type', K.PLURAL_LABELS)} AS plural
  FROM signals GROUP BY signal_type""")
def _(t: Tables):
    return t.signals.groupBy("signal_type").agg(F.count("*").alias("n")).select(
        "signal_type", "n", X.is_urgent("signal_type").alias("urgent"),
        X.provenance_verb("signal_type").alias("verb"), X.plural_label("signal_type").alias("plural"),
    )
