"""Matching, run monitoring, outreach and event rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import dates as D
from ..functions import display as X
from ..operators import events as E
from ..operators import match as H
from ..operators import monitor as N
from ..operators import outreach as O
from ..operators import report as R
from .oracle_tables import AS_OF, PHX_TODAY, case_of, lst, q, report_sql
from .registry import Tables, query

# --- matching ------------------------------------------------------------------------------------

_TRUSTEE = "list_contains(string_split(signal_types, ','), 'trustee_sale')"
_RANKED = f"""
  SELECT *, row_number() OVER (PARTITION BY lender ORDER BY
      CASE WHEN NOT lender THEN 0 WHEN {_TRUSTEE} AND coalesce(years_owned, 0) >= 10 THEN 0
           WHEN {_TRUSTEE} THEN 1 ELSE 2 END,
      stacked_types DESC, score DESC NULLS LAST, event_date DESC NULLS LAST, pos) AS rk
  FROM pool, (VALUES (true), (false)) l(lender)"""
_LISTS = """list_filter(list_transform(string_split(coalesce(zips, ''), ','), lambda x: trim(x)), lambda x: x <> '') AS zl,
  list_filter(list_transform(string_split(lower(coalesce(cities, '')), ','), lambda x: trim(x)), lambda x: x <> '') AS cl"""
_PAIRS = f"""
  SELECT p.id AS prospect_id, p.rank AS p_rank, r.*,
    CASE WHEN list_contains(zl, situs_zip) THEN 0 WHEN list_contains(cl, lower(situs_city)) THEN 1 ELSE 2 END AS tier_no
  FROM (SELECT *, {_LISTS} FROM prospects) p JOIN ({_RANKED}) r
    ON r.lender = (coalesce(p.segment, '') = 'lender')"""
_TIER = "(['zip', 'city', 'any'])[tier_no + 1]"
_TOP2 = f"""
  SELECT prospect_id, rn::INT AS rank, {_TIER} AS tier, pos FROM (
    SELECT *, row_number() OVER (PARTITION BY prospect_id ORDER BY tier_no, rk) AS rn FROM ({_PAIRS}))
  WHERE rn <= 2"""


def _pool(t: Tables):
    return H.lead_pool(t.report(168, 400))


def _top2(t: Tables):
    pool = _pool(t)
    return H.match_top2(t.prospects, pool), pool


@query("lead_rank", f"SELECT apn, lender, pos, rk FROM ({_RANKED})")
def _(t: Tables):
    return H.lead_rank(_pool(t)).select("apn", "lender", "pos", "rk")


@query("match_tiers", f"SELECT prospect_id, pos, {_TIER} AS tier, rk FROM ({_PAIRS})")
def _(t: Tables):
    return H.match_tiers(t.prospects, _pool(t)).select("prospect_id", "pos", "tier", "rk")


@query("match_top2", _TOP2)
def _(t: Tables):
    return _top2(t)[0]


@query("match_rows", f"""
  SELECT m.prospect_id, DATE '2024-01-30' AS match_date, m.rank, l.apn, m.tier AS match_tier, l.owner_name,
    l.situs_zip, l.signal_types, l.event_date, l.years_owned, l.absentee::INT AS absentee
  FROM ({_TOP2}) m JOIN pool l USING (pos)""")
def _(t: Tables):
    top2, pool = _top2(t)
    return H.match_rows(top2, pool, "2024-01-30").select(
        "prospect_id", "match_date", "rank", "apn", "match_tier", "owner_name", "situs_zip",
        "signal_types", "event_date", "years_owned", "absentee",
    )


# One prospect after the other; `used` counts how often each lead (by key) has been given away.
_LEAD_KEY = "coalesce(apn, concat_ws('|', coalesce(owner_name, ''), signal_type, coalesce(situs_address, '')))"
_GIVEN = f"""
  WITH RECURSIVE keyed AS (SELECT *, dense_rank() OVER (ORDER BY {_LEAD_KEY}) AS k FROM ({_PAIRS})),
  asked AS (
    SELECT row_number() OVER (ORDER BY p.rank NULLS LAST, p.id) AS n, p.id,
      (SELECT list({{'t': tier_no, 'rk': rk, 'k': k, 'pos': pos}}) FROM keyed WHERE prospect_id = p.id) AS leads
    FROM prospects p),
  fold(n, id, picks, used) AS (
    SELECT 0::BIGINT, NULL::BIGINT, NULL::STRUCT(t INTEGER, u INTEGER, rk BIGINT, k BIGINT, pos INTEGER)[],
      list_transform(range(1, 1 + (SELECT coalesce(max(k), 0) FROM keyed)), lambda i: 0)
    UNION ALL
    SELECT n, id, picks, list_transform(used, lambda u, i: u + list_count(list_filter(picks, lambda x: x.k = i)))
    FROM (
      SELECT n, id, used, CASE WHEN len(s) = 0 THEN [] ELSE
        [s[1]] || list_filter(s, lambda x: x.k <> s[1].k)[1:1] END AS picks
      FROM (
        SELECT a.n, a.id, f.used, list_sort(list_transform(
          list_filter(coalesce(a.leads, []), lambda x: f.used[x.k] < 3),
          lambda x: {{'t': x.t::INTEGER, 'u': f.used[x.k]::INTEGER, 'rk': x.rk::BIGINT, 'k': x.k::BIGINT, 'pos': x.pos::INTEGER}})) AS s
        FROM fold f JOIN asked a ON a.n = f.n + 1)))
  SELECT id AS prospect_id, i::INT AS rank, (['zip', 'city', 'any'])[picks[i].t + 1] AS tier, picks[i].pos::INT AS pos
  FROM fold, range(1, 3) r(i) WHERE n > 0 AND i <= len(picks)"""


@query("match_leads", _GIVEN)
def _(t: Tables):
    return H.match_leads(t.prospects, _pool(t))


# The same by region: the fold goes on in each region by itself.
_REGION = "CASE WHEN len(cl) > 0 THEN cl[1] ELSE '' END"
_GIVEN_BY_REGION = f"""
  WITH RECURSIVE keyed AS (
    SELECT k.*, dense_rank() OVER (ORDER BY {_LEAD_KEY}) AS k FROM (
      SELECT r.*, {_REGION} AS region FROM ({_PAIRS.replace("r.*,", "r.*, cl,")}) r) k
    WHERE region = coalesce(nullif(lower(situs_city), ''), '')),
  asked AS (
    SELECT row_number() OVER (PARTITION BY region ORDER BY rank NULLS LAST, id) AS n, region, id,
      (SELECT list({{'t': tier_no, 'rk': rk, 'k': k, 'pos': pos}}) FROM keyed WHERE prospect_id = p.id) AS leads
    FROM (SELECT *, {_REGION} AS region FROM (SELECT *, {_LISTS} FROM prospects)) p),
  fold(region, n, id, picks, used) AS (
    SELECT DISTINCT region, 0::BIGINT, NULL::BIGINT, NULL::STRUCT(t INTEGER, u INTEGER, rk BIGINT, k BIGINT, pos INTEGER)[],
      list_transform(range(1, 1 + (SELECT coalesce(max(k), 0) FROM keyed)), lambda i: 0) FROM asked
    UNION ALL
    SELECT region, n, id, picks, list_transform(used, lambda u, i: u + list_count(list_filter(picks, lambda x: x.k = i)))
    FROM (
      SELECT region, n, id, used, CASE WHEN len(s) = 0 THEN [] ELSE
        [s[1]] || list_filter(s, lambda x: x.k <> s[1].k)[1:1] END AS picks
      FROM (
        SELECT a.region, a.n, a.id, f.used, list_sort(list_transform(
          list_filter(coalesce(a.leads, []), lambda x: f.used[x.k] < 3),
          lambda x: {{'t': x.t::INTEGER, 'u': f.used[x.k]::INTEGER, 'rk': x.rk::BIGINT, 'k': x.k::BIGINT, 'pos': x.pos::INTEGER}})) AS s
        FROM fold f JOIN asked a ON a.n = f.n + 1 AND a.region = f.region)))
  SELECT id AS prospect_id, i::INT AS rank, (['zip', 'city', 'any'])[picks[i].t + 1] AS tier, picks[i].pos::INT AS pos
  FROM fold, range(1, 3) r(i) WHERE n > 0 AND i <= len(picks)"""


@query("match_leads_by_region", _GIVEN_BY_REGION)
def _(t: Tables):
    return H.match_leads(t.prospects, _pool(t), mode="by_region")


@query("prospect_match_shape", f"""
  SELECT p.id, p.rank, p.company, p.contact_name, p.email, p.segment, coalesce(m.leads, '') AS leads
  FROM prospects p LEFT JOIN (
    SELECT prospect_id, string_agg(apn || ':' || tier, ';' ORDER BY rank) AS leads
    FROM (SELECT m.prospect_id, m.rank, m.tier, l.apn FROM ({_TOP2}) m JOIN pool l USING (pos)) GROUP BY 1) m
    ON m.prospect_id = p.id""")
def _(t: Tables):
    top2, pool = _top2(t)
    shaped = H.prospect_match_shape(H.match_rows(top2, pool, "2024-01-30"), t.prospects)
    text = F.transform("leads", lambda x: F.concat_ws(":", x["apn"], x["match_tier"]))
    return shaped.withColumn("leads", F.coalesce(F.array_join(text, ";"), F.lit("")))


def _stored_matches(t: Tables):
    """Matches of two days; the newer day has its second lead replaced."""
    top2, pool = _top2(t)
    rows = H.match_rows(top2, pool, "2024-01-30").withColumn("created_at", F.lit(1))
    older = rows.withColumn("match_date", F.lit("2024-01-29").cast("date"))
    newer = rows.where(F.col("rank") == 2).withColumns(
        {"pitch_line": F.lit("changed"), "created_at": F.lit(2)}
    )
    return H.upsert_prospect_matches(rows.unionByName(older), newer)


@query("upsert_prospect_matches", f"""
  SELECT prospect_id, d AS match_date, rank, tier AS match_tier,
    d = DATE '2024-01-30' AND rank = 2 AS changed, 1 AS created_at
  FROM ({_TOP2}), (VALUES (DATE '2024-01-29'), (DATE '2024-01-30')) v(d)""")
def _(t: Tables):
    return _stored_matches(t).select(
        "prospect_id", "match_date", "rank", "match_tier",
        (F.col("pitch_line") == "changed").alias("changed"), "created_at",
    )


@query("prospect_match_latest", f"""
  SELECT prospect_id, DATE '2024-01-30' AS match_date, string_agg(rank || tier, ',' ORDER BY rank) AS matches
  FROM ({_TOP2}) GROUP BY 1""")
def _(t: Tables):
    text = F.transform("matches", lambda m: F.concat(m["rank"], m["match_tier"]))
    return H.prospect_match_latest(_stored_matches(t)).withColumn(
        "matches", F.array_join(text, ",")
    )


# --- monitoring ------------------------------------------------------------------------------------

_BEFORE = "2024-01-29 00:00:00"
_MEDIANS = f"""
  SELECT source, median(rows_found) AS median FROM (
    SELECT * FROM runs WHERE status = 'ok' AND started_at < TIMESTAMP '{_BEFORE}'
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY started_at DESC) <= 14) GROUP BY 1"""


def _medians(t: Tables):
    return N.recent_median(t.scrape_runs, _BEFORE)


@query("recent_median", _MEDIANS)
def _(t: Tables):
    return _medians(t)


_DROPS = f"""
  SELECT r.source, r.id, r.rows_found AS found, m.median,
    coalesce(m.median > 0 AND (r.rows_found = 0 OR (m.median >= 50 AND r.rows_found < m.median * 0.1)), false) AS warn,
    r.source IN ({', '.join(q(s) for s in K.CRITICAL_SOURCES)}) AS critical
  FROM runs r LEFT JOIN ({_MEDIANS}) m USING (source) WHERE r.status = 'ok'"""


def _drops(t: Tables):
    today = t.scrape_runs.select("source", "status", F.col("rows_found").alias("found"))
    return N.volume_drop(today, _medians(t))


@query("volume_drop", f"SELECT source, found, median, warn, critical FROM ({_DROPS})")
def _(t: Tables):
    return _drops(t)


@query("mark_run_warn", f"""
  SELECT id, source, CASE WHEN status = 'ok' AND source IN (SELECT source FROM ({_DROPS}) WHERE warn)
      AND (started_at - INTERVAL 7 HOUR)::DATE = DATE '2024-01-12' THEN 'warn' ELSE status END AS status
  FROM runs""")
def _(t: Tables):
    return N.mark_run_warn(t.scrape_runs, _drops(t), "2024-01-12").select("id", "source", "status")


@query("pipeline_day_join", """
  SELECT id, source, status FROM runs
  WHERE (started_at - INTERVAL 7 HOUR)::DATE = (SELECT max((started_at - INTERVAL 7 HOUR)::DATE) FROM runs)""")
def _(t: Tables):
    return N.pipeline_day_join(t.scrape_runs).select("id", "source", "status")


@query("pipeline_day_status", """
  SELECT (max(started_at) - INTERVAL 7 HOUR)::DATE AS day, min(started_at) AS started_at, max(finished_at) AS finished_at,
    count(DISTINCT source) AS n_sources, count_if(status = 'ok') AS n_ok, count_if(status = 'warn') AS n_warn,
    count_if(status = 'error') AS n_error,
    coalesce(string_agg(DISTINCT source, ',' ORDER BY source) FILTER (status = 'warn'), '') AS warn_sources,
    coalesce(string_agg(DISTINCT source, ',' ORDER BY source) FILTER (status = 'error'), '') AS error_sources
  FROM runs
  WHERE (started_at - INTERVAL 7 HOUR)::DATE = (SELECT max((started_at - INTERVAL 7 HOUR)::DATE) FROM runs)""")
def _(t: Tables):
    return N.pipeline_day_status(t.scrape_runs).withColumns({
        c: F.array_join(c, ",") for c in ("warn_sources", "error_sources")
    })


@query("sources_complete_today", """
  SELECT count(DISTINCT source) AS n_done, count(DISTINCT source) = 2 AS complete FROM runs
  WHERE source IN ('court_probate', 'recorder_nots') AND status = 'ok' AND rows_found > 0
    AND error IS DISTINCT FROM 'busy-stop'
    AND started_at >= TIMESTAMP '2024-01-20 07:00:00' AND started_at < TIMESTAMP '2024-01-21 07:00:00'""")
def _(t: Tables):
    return N.sources_complete_today(
        t.scrape_runs, ["court_probate", "recorder_nots"], "2024-01-21 02:00:00"
    )


@query("todays_run", """
  SELECT id, started_at FROM runs WHERE source = 'recorder_nots' AND status IN ('ok', 'warn')
    AND started_at >= TIMESTAMP '2024-01-20 07:00:00' AND started_at < TIMESTAMP '2024-01-21 07:00:00'
  ORDER BY started_at DESC LIMIT 1""")
def _(t: Tables):
    return N.todays_run(t.scrape_runs, "recorder_nots", "2024-01-21 02:00:00").select("id", "started_at")


@query("source_max_date", "SELECT source, max(event_date) AS source_max_date FROM signals GROUP BY source")
def _(t: Tables):
    return N.source_max_date(t.signals)


@query("run_metrics", f"""
  SELECT source, {AS_OF} AS started_at, count(*)::INT AS rows_found,
    count_if(created_at >= TIMESTAMP '2024-01-20')::INT AS rows_new, 'ok' AS status, max(event_date) AS source_max_date
  FROM signals WHERE created_at >= TIMESTAMP '2024-01-10' GROUP BY source""")
def _(t: Tables):
    from ..operators.merge import merge_metrics

    batch = t.signals.where(F.col("created_at") >= "2024-01-10")
    stored = t.signals.where(F.col("created_at") < "2024-01-20")
    runs = N.run_metrics(merge_metrics(stored, batch), batch, t.as_of)
    return runs.select("source", "started_at", "rows_found", "rows_new", "status", "source_max_date")


@query("max_case_number", """
  SELECT coalesce(max(external_id::BIGINT), 0) AS max_n FROM signals
  WHERE source = 'phoenix_code' AND external_id::BIGINT % 3 <> 0""")
def _(t: Tables):
    e = F.col("external_id").cast("bigint")
    cases = t.signals.withColumn("external_id", F.concat(
        F.when(e % 3 != 0, F.lit("PEF2024-")).otherwise("PEF2023-"), "external_id"))
    return N.max_case_number(cases, "phoenix_code", 2024)


# --- prospects --------------------------------------------------------------------------------------

_WHO = ["id", "rank", "company", "segment"]


@query("select_prospects", f"""
  SELECT {', '.join(_WHO)} FROM prospects WHERE segment = 'lender' AND id IN (3, 9, 14, 20, 37, 41, 60)""")
def _(t: Tables):
    return O.select_prospects(t.prospects, "lender", [3, 9, 14, 20, 37, 41, 60]).select(*_WHO)


@query("populate_prospect_geo", """
  SELECT id, CASE WHEN notes LIKE 'Office:%' THEN regexp_extract(notes, '(\\d{5})$', 1) ELSE zips END AS zips,
    CASE WHEN notes LIKE 'Office:%' THEN trim(string_split(notes, ',')[2]) ELSE cities END AS cities
  FROM prospects""")
def _(t: Tables):
    return O.populate_prospect_geo(t.prospects).select("id", "zips", "cities")


_ASSIGNED = f"""
  SELECT p.*, coalesce(p.subject_variant, ({lst(K.VARIANTS)})[((taken + rn - 1) % 4) + 1]) AS v FROM (
    SELECT *, count(subject_variant) OVER (PARTITION BY segment) AS taken,
      row_number() OVER (PARTITION BY segment, subject_variant IS NULL ORDER BY rank NULLS FIRST, id) AS rn
    FROM prospects) p"""


@query("assign_variants", f"SELECT id, segment, v AS subject_variant FROM ({_ASSIGNED})")
def _(t: Tables):
    return O.assign_variants(t.prospects).select("id", "segment", "subject_variant")


def _byte(i: int) -> str:
    return f"('0x' || d[{2 * i + 1}:{2 * i + 2}])::INT % 62 + 1"


@query("ensure_link_codes", f"""
  SELECT id, coalesce(link_code, {' || '.join(f"({q(O.LINK_ALPHABET)})[{_byte(i)}]" for i in range(8))}) AS link_code
  FROM (SELECT *, md5('salt|' || id::VARCHAR || '|0') AS d FROM prospects)""")
def _(t: Tables):
    return O.ensure_link_codes(t.prospects, "salt").select("id", "link_code")


@query("prospects_with_email", "SELECT count_if(email <> '') AS n FROM prospects")
def _(t: Tables):
    return O.prospects_with_email(t.prospects)


@query("latest_campaign", "SELECT max(event_id % 2 + 1) AS id FROM events")
def _(t: Tables):
    return O.latest_campaign(t.outreach_events.select(F.col("campaign_id").alias("id")).distinct())


@query("trial_clicks_named", """
  SELECT t.event_id AS id, t.user_id AS prospect_id, p.company, p.contact_name
  FROM events t LEFT JOIN prospects p ON p.id = t.user_id WHERE t.event_type = 'purchase'""")
def _(t: Tables):
    clicks = t.raw("events").where(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("prospect_id"))
    return O.trial_clicks_named(clicks, t.prospects)


@query("access_requests_dedupe", """
  SELECT id, email, CASE WHEN segment <> 'other' THEN segment END AS segment, 'src' || id::VARCHAR AS source FROM (
    SELECT event_id AS id, 'user' || user_id::VARCHAR || '@mail.example' AS email,
      (['wholesaler', 'lender', 'attorney', 'other'])[event_id % 4 + 1] AS segment
    FROM events WHERE event_type = 'signup' AND event_id % 6 <> 1 AND event_id % 5 <> 0)
  QUALIFY row_number() OVER (PARTITION BY email ORDER BY id) = 1""")
def _(t: Tables):
    return O.access_requests_dedupe(t.access_requests)


# --- campaigns ---------------------------------------------------------------------------------------

_STAGES = ", ".join(
    f"count(DISTINCT prospect_id) FILTER (event = '{e}') AS {e}" for e in K.FUNNEL_EVENTS)


@query("campaign_funnel", f"""
  SELECT (SELECT count(subject_variant) FROM prospects) AS assigned, {_STAGES}
  FROM outreach WHERE campaign_id = 2""")
def _(t: Tables):
    return O.campaign_funnel(t.outreach_events, t.prospects, 2)


_VSTAGES = ["sent", "opened", "clicked", "replied", "trial"]


@query("variant_stats", f"""
  SELECT *, {', '.join(f"CASE WHEN sent > 0 THEN floor({c} / sent * 1000 + 0.5) / 10 END AS {c}_pct" for c in _VSTAGES[1:])}
  FROM (SELECT v.variant, (SELECT count(*) FROM prospects p WHERE p.subject_variant = v.variant) AS assigned,
      {', '.join(f"(SELECT count(DISTINCT prospect_id) FROM outreach o WHERE o.variant = v.variant AND campaign_id = 1 AND event = '{c}') AS {c}" for c in _VSTAGES)}
    FROM (VALUES ('A'), ('B'), ('C'), ('D')) v(variant))""")
def _(t: Tables):
    return O.variant_stats(t.outreach_events, t.prospects, 1)


_HEALTH = f"""
  SELECT count(DISTINCT day) FILTER (event = 'sent') AS send_days,
    count(DISTINCT prospect_id) FILTER (event = 'sent' AND day = {PHX_TODAY}) AS sent_today,
    any_value(prev) AS prev_send_day,
    count_if(event = 'stop' AND day >= prev) AS stops_since,
    count_if(event = 'bounced' AND day >= prev) AS bounces_since,
    count(DISTINCT prospect_id) FILTER (event = 'sent') AS sent_total,
    count(DISTINCT prospect_id) FILTER (event = 'bounced') AS bounced_total
  FROM (SELECT *, (created_at - INTERVAL 7 HOUR)::DATE AS day,
      (SELECT max((created_at - INTERVAL 7 HOUR)::DATE) FROM outreach
       WHERE event = 'sent' AND (created_at - INTERVAL 7 HOUR)::DATE < {PHX_TODAY}) AS prev
    FROM outreach)"""


@query("outreach_health", _HEALTH)
def _(t: Tables):
    return O.outreach_health(t.outreach_events, t.as_of)


@query("ramp_and_halt", f"""
  SELECT send_days, sent_today, target, greatest(0, least(target - sent_today, 20 - sent_today))::BIGINT AS remaining,
    halt_reason, halt_reason IS NOT NULL AS halt
  FROM (SELECT *, (CASE WHEN send_days < 5 THEN 10 ELSE 15 END)::BIGINT AS target,
      CASE WHEN stops_since > 0 THEN stops_since::VARCHAR || ' stop event(s) since the previous send day'
           WHEN bounces_since > 0 THEN bounces_since::VARCHAR || ' bounce(s) since the previous send day'
           WHEN bounced_total / nullif(sent_total, 0) > 0.03
           THEN 'bounce rate ' || printf('%.1f', bounced_total / sent_total * 100) || '% exceeds 3%' END AS halt_reason
    FROM ({_HEALTH}))""")
def _(t: Tables):
    return O.ramp_and_halt(O.outreach_health(t.outreach_events, t.as_of)).select(
        "send_days", "sent_today", "target", "remaining", "halt_reason", "halt"
    )


_FLAG = f"""CASE WHEN split_part(lower(split_part(email, '@', 1)), '+', 1) IN ({', '.join(q(r) for r in K.ROLE_LOCAL_PARTS)})
    THEN 'shared' WHEN email IS NOT NULL AND url <> ''
    AND lower(split_part(email, '@', 2)) <> 'firm' || id::VARCHAR || '.example' THEN 'third-party' END"""


@query("classify_inbox", f"SELECT id, {_FLAG} AS inbox_flag FROM prospects")
def _(t: Tables):
    return t.prospects.select("id", X.classify_inbox("email", "url").alias("inbox_flag"))


_CANDS = f"""
  SELECT p.*, {_FLAG} AS inbox_flag,
    p.id IN (SELECT prospect_id FROM ({_TOP2}) WHERE tier <> 'any') AS near,
    EXISTS (SELECT 1 FROM outreach o WHERE o.prospect_id = p.id AND o.id % 97 + 1 = 2 AND o.event = 'sent')
      AS already_sent
  FROM prospects p"""
_ELIGIBLE = f"""
  SELECT * FROM ({_CANDS}) WHERE status = 'new' AND email IS NOT NULL AND inbox_flag IS NULL
    AND segment IS DISTINCT FROM 'community_leader' AND subject_variant IS NOT NULL AND NOT already_sent"""
_BATCH = f"""
  SELECT *, CASE WHEN near THEN 0 WHEN segment = 'lender' THEN 1 ELSE 2 END AS tier FROM ({_ELIGIBLE})
  ORDER BY tier, rank NULLS FIRST, id LIMIT 15"""


def _campaigns(t: Tables):
    """All events, dealt to 97 campaigns, so that each leaves prospects without a message."""
    return t.outreach_events.withColumn("campaign_id", F.col("id") % 97 + 1)


def _cands(t: Tables):
    top2, pool = _top2(t)
    rows = H.match_rows(top2, pool, "2024-01-30")
    return O.with_candidate_columns(t.prospects, rows, _campaigns(t), 2)


@query("eligible_prospects", f"SELECT id, segment, near FROM ({_ELIGIBLE})")
def _(t: Tables):
    return O.eligible_prospects(_cands(t)).select("id", "segment", "near")


@query("select_batch", f"SELECT id, rank, tier FROM ({_BATCH})")
def _(t: Tables):
    return O.select_batch(_cands(t), 15).select("id", "rank", "tier")


def _short(company: str) -> str:
    cut = f"trim(regexp_replace({company}, '( – | - | \\(|,).*$', ''))"
    return f"trim(regexp_replace({cut}, '(?i)[,\\s]+(LLC|L\\.L\\.C\\.|Inc|Incorporated|Corp|Corporation|Co|Company|Group)\\.?$', ''))"


_N7 = f"""(SELECT count(*) FROM (
    {report_sql(168, f"event_date >= ({AS_OF} - INTERVAL 336 HOUR)::DATE")}))::VARCHAR"""


def _numbers(t: Tables):
    return R.report_numbers(t.signals, t.properties, t.scores, t.as_of)


def _subject(variant: str, n7: str) -> str:
    s = _short("company")
    return f"""CASE {variant} WHEN 'A' THEN 'who filed in maricopa this morning?'
      WHEN 'B' THEN {n7} || ' maricopa filings this week'
      WHEN 'C' THEN CASE WHEN {s} = '' OR length({s}) > 28 OR regexp_matches({s}, '(?i)s$')
        THEN 'your next maricopa seller?' ELSE {s} || '''s next maricopa seller?' END
      WHEN 'D' THEN 'before it hits propstream' END"""


@query("subject_for", f"""
  SELECT id, variant, {_subject('variant', "(id * 7)::VARCHAR")} AS subject
  FROM prospects, (VALUES ('A'), ('B'), ('C'), ('D'), ('E'), (NULL)) v(variant)""")
def _(t: Tables):
    variants = F.array(*[F.lit(v).cast("string") for v in (*K.VARIANTS, "E", None)])
    rows = t.prospects.select("id", "company", F.explode(variants).alias("variant"))
    return rows.select("id", "variant", X.subject_for("variant", "company", F.col("id") * 7).alias("subject"))


@query("next_batch", f"""
  SELECT id AS prospect_id, (SELECT max(event_id % 2 + 1) FROM events) AS campaign_id, subject_variant AS variant,
    email AS "to", contact_name AS to_name, {_subject('subject_variant', _N7)} AS subject
  FROM ({_BATCH}) WHERE link_code IS NOT NULL""")
def _(t: Tables):
    top2, pool = _top2(t)
    numbers = _numbers(t)
    campaigns = t.outreach_events.select(F.col("campaign_id").alias("id")).distinct()
    return O.next_batch(
        t.prospects, H.match_rows(top2, pool, "2024-01-30"), _campaigns(t), campaigns, numbers, 2, 15
    )


@query("send_sheet", f"""
  SELECT id, rank, company, segment, status, subject_variant AS variant,
    coalesce(nullif(split_part(trim(coalesce(contact_name, '')), ' ', 1), ''), 'there') AS first_name,
    {', '.join(f"{_subject(q(v), _N7)} AS subject_{v.lower()}" for v in K.VARIANTS)},
    m.match_date, coalesce(m.matches, '') AS matches, {_FLAG} AS inbox_flag
  FROM prospects LEFT JOIN (
    SELECT prospect_id, DATE '2024-01-30' AS match_date, string_agg(tier, ',' ORDER BY rank) AS matches
    FROM ({_TOP2}) GROUP BY 1 HAVING count(*) >= 2) m ON m.prospect_id = id
  WHERE status <> 'stop'""")
def _(t: Tables):
    top2, pool = _top2(t)
    latest = H.prospect_match_latest(H.match_rows(top2, pool, "2024-01-30"))
    numbers = _numbers(t)
    sheet = O.send_sheet_order(O.send_sheet(t.prospects, latest, numbers))
    tiers = F.array_join(F.transform("matches", lambda m: m["match_tier"]), ",")
    return sheet.withColumn("matches", F.coalesce(tiers, F.lit(""))).drop(
        "contact_name", "email", "phone", "url"
    )


@query("send_sheet_order", f"""
  SELECT p.id, p.rank, {_FLAG} IS NOT NULL AS flagged,
    first_value(coalesce(rank, 0)) OVER w AS segment_rank, first_value(id) OVER w AS segment_first
  FROM prospects p WHERE status <> 'stop'
  WINDOW w AS (PARTITION BY coalesce(segment, '') ORDER BY coalesce(rank, 0), id
               ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def _(t: Tables):
    sheet = t.prospects.where(F.col("status") != "stop").select(
        "id", "rank", "segment", X.classify_inbox("email", "url").alias("inbox_flag"))
    return O.send_sheet_keys(sheet).select("id", "rank", *O.SHEET_KEYS)


# --- engagement --------------------------------------------------------------------------------------

_BOT = "coalesce(click_k % 9 <> 0 AND click_k % 4 = 0, false)"
_ROLLUP = f"""
  SELECT prospect_id, min("at") FILTER (kind = 'click') AS first_click_at, max("at") AS last_seen,
    count_if(kind = 'click' AND NOT bot) AS human_clicks, count_if(kind = 'click' AND bot) AS bot_clicks,
    count(DISTINCT session_id) AS sessions,
    round(coalesce(sum(ms) FILTER (event = 'engaged_time' AND starts_with(path, '/report')), 0), 3) AS engaged_ms,
    count(DISTINCT path) FILTER (event = 'pageview') AS pages_visited,
    count_if(event = 'row_expand') AS rows_expanded, count_if(event = 'export_click') AS export_clicks,
    count_if(event = 'cta_click') AS cta_clicks
  FROM (SELECT prospect_id, created_at AS "at", 'click' AS kind, event, NULL AS path, {_BOT} AS bot,
          NULL AS session_id, NULL AS ms FROM outreach WHERE event = 'clicked' AND prospect_id IS NOT NULL
        UNION ALL
        SELECT prospect_id, created_at, 'page', event, path, NULL, session_id, ms FROM page_events
        WHERE prospect_id IS NOT NULL) GROUP BY 1"""


def _pages(t: Tables):
    return E.clean_page_events(t.raw_page_events)


@query("clean_page_events", "SELECT id, vid, prospect_id, session_id, path, event, meta, ms, created_at FROM page_events")
def _(t: Tables):
    return _pages(t)


@query("engagement_rollup", f"""
  SELECT r.*, coalesce(p.company, '#' || r.prospect_id::VARCHAR) AS company, p.contact_name, p.segment,
    p.subject_variant AS variant FROM ({_ROLLUP}) r LEFT JOIN prospects p ON p.id = r.prospect_id""")
def _(t: Tables):
    return O.engagement_rollup(t.outreach_events, _pages(t), t.prospects)


@query("engagement_totals", f"""
  SELECT count_if(human_clicks > 0) AS clicked_human, count_if(engaged_ms >= 30000) AS engaged_over_30s
  FROM ({_ROLLUP})""")
def _(t: Tables):
    return O.engagement_totals(O.engagement_rollup(t.outreach_events, _pages(t), t.prospects))


@query("engagement_timeline", f"""
  SELECT prospect_id, created_at AS "at", 'click' AS kind, event, NULL::VARCHAR AS path, {_BOT} AS bot
  FROM outreach WHERE event = 'clicked' AND prospect_id IS NOT NULL
  UNION ALL SELECT prospect_id, created_at, 'page', event, path, NULL FROM page_events
  WHERE prospect_id IS NOT NULL""")
def _(t: Tables):
    return O.engagement_timeline(t.outreach_events, _pages(t))


@query("engagement_pages", """
  SELECT DISTINCT prospect_id, path FROM page_events WHERE event = 'pageview' AND prospect_id IS NOT NULL""")
def _(t: Tables):
    return O.engagement_pages(_pages(t))


# --- event rules ----------------------------------------------------------------------------------------

_LIMITED = """
  SELECT a.id, a.vid, (SELECT count(*) FROM page_events b WHERE b.vid = a.vid
      AND (b.created_at, b.id) <= (a.created_at, a.id)
      AND b.created_at > a.created_at - INTERVAL {secs} SECOND) AS hits
  FROM page_events a"""


@query("rate_limit", f"""
  SELECT id, vid, hits, hits > 120 AS limited FROM ({_LIMITED.format(secs=60)})""")
def _(t: Tables):
    return E.rate_limit(_pages(t)).select("id", "vid", "hits", "limited")


@query("rate_limit_daily", f"""
  SELECT id, vid, hits, hits > 3 AS limited FROM ({_LIMITED.format(secs=86400)})""")
def _(t: Tables):
    return E.rate_limit(_pages(t), n=3, secs=86400).select("id", "vid", "hits", "limited")


def _dedupe_sql(hours: int) -> str:
    return f"""
  WITH RECURSIVE opens AS (
    SELECT prospect_id, campaign_id, created_at, min(id) AS id FROM outreach WHERE event = 'opened' GROUP BY ALL),
  kept AS (
    SELECT prospect_id, campaign_id, min(created_at) AS kt FROM opens GROUP BY ALL
    UNION ALL
    SELECT k.prospect_id, k.campaign_id, (SELECT min(o.created_at) FROM opens o
        WHERE o.prospect_id IS NOT DISTINCT FROM k.prospect_id AND o.campaign_id = k.campaign_id
          AND o.created_at >= k.kt + INTERVAL {hours} HOUR)
    FROM kept k WHERE k.kt IS NOT NULL)
  SELECT o.id, o.prospect_id, o.campaign_id, o.created_at FROM opens o JOIN kept k
    ON o.prospect_id IS NOT DISTINCT FROM k.prospect_id AND o.campaign_id = k.campaign_id AND o.created_at = k.kt"""


_OPEN_COLS = ["id", "prospect_id", "campaign_id", "created_at"]


@query("dedupe_opens", _dedupe_sql(1))
def _(t: Tables):
    return E.dedupe_opens(t.outreach_events).select(*_OPEN_COLS)


@query("dedupe_opens_weekly", _dedupe_sql(168))
def _(t: Tables):
    return E.dedupe_opens(t.outreach_events, hours=168).select(*_OPEN_COLS)


@query("click_after_send_asof", """
  SELECT id, prospect_id, created_at, sent_at, coalesce(created_at - sent_at < INTERVAL 12 HOUR, false) AS too_soon FROM (
    SELECT c.id, c.prospect_id, c.created_at,
      (SELECT max(s.created_at) FROM outreach s WHERE s.event = 'sent' AND s.prospect_id = c.prospect_id
        AND s.created_at <= c.created_at) AS sent_at
    FROM outreach c WHERE c.event = 'clicked' AND c.prospect_id IS NOT NULL)""")
def _(t: Tables):
    return E.click_after_send_asof(t.outreach_events, secs=43200).select(
        "id", "prospect_id", "created_at", "sent_at", "too_soon"
    )


@query("prospect_status_fold", """
  WITH first_move AS (
    SELECT prospect_id, arg_min(event, (created_at, id)) AS first FROM outreach
    WHERE event IN ('sent', 'replied', 'trial') GROUP BY 1)
  SELECT o.prospect_id, CASE WHEN bool_or(event = 'stop') THEN 'stop' WHEN any_value(f.first) = 'trial' THEN 'trial'
      WHEN bool_or(event = 'replied') THEN 'replied' WHEN any_value(f.first) IS NOT NULL THEN 'sent' ELSE 'new' END AS status
  FROM outreach o LEFT JOIN first_move f USING (prospect_id) WHERE o.prospect_id IS NOT NULL GROUP BY 1""")
def _(t: Tables):
    return E.prospect_status_fold(t.outreach_events)


@query("customer_status_fold", f"""
  WITH b AS (
    SELECT user_id AS customer_id, ts, event_id AS id,
      event_type = 'purchase' AND event_id % 4 = 0 AS bought,
      CASE WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN 'active'
        WHEN event_type = 'signup' THEN {case_of("(['active', 'trialing', 'past_due', 'incomplete', 'canceled', 'unpaid', 'incomplete_expired', 'paused'])[(event_id // 5) % 8 + 1]", E.SUBSCRIPTION_STATES)}
        WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'past_due'
        WHEN event_type = 'click' AND event_id % 6 = 0 THEN 'canceled' END AS status
    FROM events)
  SELECT customer_id, arg_max(status, (ts, id)) AS status, max(ts) AS updated_at
  FROM b WHERE status IS NOT NULL GROUP BY 1 HAVING bool_or(bought)""")
def _(t: Tables):
    return E.customer_status_fold(t.billing_events)


_TRIALS = """
  SELECT event_id AS id, CASE WHEN event_id % 3 <> 0 THEN user_id END AS prospect_id,
    'v' || user_id::VARCHAR AS vid, ts AS started_at FROM events WHERE event_type = 'purchase'
  QUALIFY row_number() OVER (PARTITION BY event_id % 3 <> 0, user_id ORDER BY event_id) = 1"""


@query("first_trial", _TRIALS)
def _(t: Tables):
    return O.first_trial(t.trials).drop("trial_key")


@query("trial_windows", f"""
  SELECT id, prospect_id, started_at + INTERVAL 7 DAY AS ends_at, {AS_OF} < started_at + INTERVAL 7 DAY AS active,
    greatest(0, ceil((epoch_us(started_at + INTERVAL 7 DAY) - epoch_us({AS_OF})) / 86400000000))::BIGINT AS days_left
  FROM ({_TRIALS})""")
def _(t: Tables):
    return O.trial_windows(t.trials, t.as_of).select("id", "prospect_id", "ends_at", "active", "days_left")


@query("signal_counts_windowed", """
  SELECT created_at::DATE::TIMESTAMP AS window_start, (created_at::DATE + 1)::TIMESTAMP AS window_end,
    signal_type, count(*) AS n FROM signals GROUP BY ALL""")
def _(t: Tables):
    return E.signal_counts_windowed(t.signals)


@query("signal_counts_sliding", """
  SELECT (created_at::DATE - i::INT)::TIMESTAMP AS window_start, (created_at::DATE - i::INT + 7)::TIMESTAMP AS window_end,
    signal_type, count(*) AS n FROM signals, range(7) r(i) GROUP BY ALL""")
def _(t: Tables):
    return E.signal_counts_windowed(t.signals, "7 days", "1 day")
