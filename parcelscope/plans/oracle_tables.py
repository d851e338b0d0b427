"""The sample tables, and the steps several checks share, as plain SQL text."""

from __future__ import annotations

import re

from ..functions import constants as K
from . import sample_tables as S

AS_OF = f"TIMESTAMP '{S.AS_OF}'"
TODAY = f"({AS_OF})::DATE"
PHX_TODAY = f"({AS_OF} - INTERVAL 7 HOUR)::DATE"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def pick(values, n: str) -> str:
    return f"({lst(values)})[(({n}) % {len(values)}) + 1]"


def letter(n: str) -> str:
    return f"chr((65 + ({n}) % 26)::INT)"


def cap(x: str) -> str:
    return f"(upper(({x})[1]) || lower(({x})[2:]))"


def surname(k: str) -> str:
    return (f"({pick(S.SURNAMES, k)} || {letter(f'({k})//13')} || {letter(f'({k})//338')}"
            f" || {letter(f'({k})//8788')})")


def forename(k: str) -> str:
    return pick(S.FORENAMES, f"({k})//2")


def spouse(k: str) -> str:
    return pick(S.FORENAMES, f"({k})//11 + 3")


def middle(k: str) -> str:
    return letter(f"({k})//3")


def owner_name(k: str) -> str:
    ln, fn, sp, mi = surname(k), forename(k), spouse(k), middle(k)
    return f"""(CASE WHEN ({k}) % 18 = 0 THEN 'SMITH JOHN ' || {mi} || '/MARY'
      WHEN ({k}) % 3 = 0 THEN 'SMITH JOHN ' || {mi}
      WHEN (({k})//3) % 9 = 0 THEN {ln} || ' ' || {fn} || ' ' || {mi}
      WHEN (({k})//3) % 9 = 1 THEN {ln} || ' ' || {fn} || '/' || {sp}
      WHEN (({k})//3) % 9 = 2 THEN {ln} || ' ' || {fn} || ' ' || {mi} || '/' || {surname(f'({k}+1)')} || ' ' || {sp}
      WHEN (({k})//3) % 9 = 3 THEN {ln} || ' HOLDINGS LLC'
      WHEN (({k})//3) % 9 = 4 THEN {ln} || ' ' || {fn} || ' & ' || {sp}
      WHEN (({k})//3) % 9 = 5 THEN {ln} || ' FAMILY TRUST'
      WHEN (({k})//3) % 9 = 6 THEN CASE WHEN ({k}) % 2 = 0 THEN 'UNKNOWN' END
      WHEN (({k})//3) % 9 = 7 THEN {ln} || ' ' || {fn} || ' JR'
      ELSE 'THE ' || {ln} || ' BANK, N.A.' END)"""


def house(k: str) -> str:
    j = f"(({k}) - CASE WHEN ({k}) % 10 = 3 THEN 1 ELSE 0 END)"
    return (f"(({j} + 100)::VARCHAR || ' ' || {pick(S.DIRECTIONS, j)} || ' ' || "
            f"{pick(S.STREETS, j + '//4')} || ' ' || {pick(S.TYPES, j)})")


def apn(k: str) -> str:
    return f"lpad(({k})::VARCHAR, 10, '0')"


def word_regex(patterns, flags: str = "") -> str:
    return q(rf"{flags}\b({'|'.join(patterns)})\b")


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def norm_address(x: str) -> str:
    return squeeze(f"regexp_replace(upper(coalesce({x}, '')), '[.,#]', ' ', 'g')")


def norm_owner(x: str) -> str:
    base = f"regexp_replace(upper(coalesce({x}, '')), '[.,]', ' ', 'g')"
    return squeeze(f"regexp_replace({base}, {word_regex(K.OWNER_NOISE_WORDS)}, ' ', 'g')")


def name_norm(x: str) -> str:
    amp = f"regexp_replace(upper(coalesce({x}, '')), '\\bAND\\b', '&', 'g')"
    return squeeze(f"""regexp_replace({amp}, '[.,''"()\\-]+', ' ', 'g')""")


def is_entity_name(norm: str) -> str:
    return f"({norm} = '' OR regexp_matches({norm}, {word_regex(K.NAME_ENTITY_PATTERNS)}))"


def entity_key(norm: str) -> str:
    bare = squeeze(f"regexp_replace({norm}, '\\bTHE\\b', '', 'g')")
    return f"CASE WHEN length({bare}) >= 4 THEN '=' || {bare} END"


def entity_owner(x: str) -> str:
    return (f"(regexp_matches({x}, {word_regex(K.REPORT_ENTITY_WORDS, '(?i)')}) OR "
            f"regexp_matches(trim({x}), {q('(?i)^(' + '|'.join(K.PLACEHOLDER_OWNERS) + ')$')}))")


def street_only(x: str) -> str:
    tail = " (" + "|".join(sorted(K.CITIES, key=len, reverse=True)) + ")$"
    return norm_address(f"regexp_replace(trim(upper(coalesce({x}, ''))), {q(tail)}, '')")


def words_of(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda t: t <> '')"


def case_of(x: str, values: dict, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {q(str(a))} THEN {q(b) if isinstance(b, str) else b}"
                    for a, b in values.items())
    return f"(CASE {x} {arms} ELSE {default} END)"


def name_tokens(part: str) -> str:
    return (f"list_filter(string_split({part}, ' '), lambda t: t <> '' AND NOT "
            f"list_contains({lst(K.NAME_NOISE_WORDS)}, t) AND NOT regexp_full_match(t, '\\d+'))")


def _name_parts(table: str, key: str, name: str, where: str) -> str:
    """Person parts of names as rows: key columns, pos, full words, initials."""
    norm = name_norm(name)
    split = f"list_filter(string_split_regex({norm}, '\\s*[/&]\\s*'), lambda x: x <> '')"
    return f"""
      SELECT {key}, pos, list_filter(toks, lambda t: length(t) > 1) AS full_words,
             list_filter(toks, lambda t: length(t) = 1) AS initials
      FROM (SELECT {key}, pos, {name_tokens('part')} AS toks
            FROM (SELECT {key}, unnest(l) AS part, generate_subscripts(l, 1) AS pos
                  FROM (SELECT {key}, {split} AS l FROM {table}
                        WHERE {where} AND NOT {is_entity_name(norm)})))"""


PARCEL = "CASE WHEN event_id % 6 = 1 THEN 7 ELSE user_id * 10 + event_id % 10 END"
_J = f"(CASE WHEN parcel % 3 = 0 THEN 'JOHN' ELSE {forename('parcel')} END)"
_L = f"(CASE WHEN parcel % 3 = 0 THEN 'SMITH' ELSE {surname('parcel')} END)"

# initcap: first letter of every blank-separated word
initcap_sql_open = "array_to_string(list_transform(string_split("
initcap_sql_close = ", ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"

TABLES: dict[str, str] = {
    "properties": f"""
      SELECT {apn('c_custkey')} AS apn,
        CASE WHEN c_custkey % 6 = 5
             THEN concat_ws(' ', s, (c_custkey % 50)::VARCHAR, (c_custkey % 50)::VARCHAR)
             ELSE s END AS situs_address,
        CASE WHEN c_custkey % 23 <> 0 THEN {pick(S.CITIES, 'c_nationkey')} END AS situs_city,
        (85000 + c_custkey % 300)::VARCHAR AS situs_zip,
        {owner_name('c_custkey')} AS owner_name,
        CASE WHEN c_custkey % 13 <> 0 THEN {house('(c_custkey + c_custkey % 2)')} || ', ' ||
             {pick(S.CITIES, 'c_custkey')} || ', AZ, ' || (85000 + c_custkey % 300)::VARCHAR
             END AS mailing_address,
        CASE WHEN c_custkey % 29 <> 0 THEN c_custkey % 5 <> 0 END AS absentee,
        CASE WHEN c_custkey % 4 = 0 THEN 'COMMERCIAL' ELSE 'RESIDENTIAL' END AS building_type,
        CASE WHEN c_custkey % 19 <> 0
             THEN DATE '1994-01-01' + ((c_custkey * 37) % 10900)::INT END AS last_sale_date,
        CASE WHEN c_custkey % 7 <> 0
             THEN ((c_custkey * 911) % 900000 + 1000)::DOUBLE END AS last_sale_price,
        CASE WHEN c_acctbal > 0 THEN c_acctbal * 100 END AS assessed_value
      FROM (SELECT *, CASE WHEN c_custkey % 17 <> 0 THEN {house('c_custkey')} END AS s
            FROM customer)""",
    "ev": """
      SELECT *, regexp_extract(props, '(\\d+)', 1)::INT AS k FROM events""",
    "signals": f"""
      SELECT CASE event_type WHEN 'error' THEN 'trustee_sale'
               WHEN 'click' THEN CASE event_id % 5 WHEN 0 THEN 'mechanics_lien' WHEN 1 THEN 'lien'
                                 ELSE 'lis_pendens' END
               WHEN 'view' THEN 'code_violation' WHEN 'purchase' THEN 'tax_delinquent'
               ELSE CASE WHEN event_id % 2 = 0 THEN 'probate' ELSE 'divorce' END END AS signal_type,
        src AS source, event_id::VARCHAR AS external_id,
        CASE WHEN event_id % 3 <> 0 THEN {apn('parcel')} END AS apn,
        CASE WHEN event_id % 31 <> 0
             THEN 'https://records.example/' || src || '/' || (event_id // 4)::VARCHAR END AS source_url,
        CASE WHEN k % 13 <> 0 THEN ts::DATE - (k % 40) END AS event_date,
        CASE WHEN event_id % 2 = 0 THEN 'open' ELSE 'closed' END AS status,
        CASE WHEN event_type IN ('error', 'click', 'signup') AND event_id % 29 <> 0 THEN
          {initcap_sql_open}CASE event_id % 5
            WHEN 0 THEN {_J} || ' ' || {middle('parcel')} || ' ' || {_L}
            WHEN 1 THEN {owner_name('parcel')}
            WHEN 2 THEN {_L} || ', ' || {_J} || ' ' || {middle('parcel')} || '.'
            WHEN 3 THEN {_L} || ' ' || {_J} || ' AND ' || {spouse('parcel')} || ' ' || {_L}
            ELSE CASE WHEN parcel % 4 = 0 THEN 'SMITH JOHN & SMITH MARY'
                      ELSE {_L} || ' HOLDINGS LLC' END END{initcap_sql_close} END AS owner_name,
        CASE WHEN event_type = 'view' THEN {house('parcel')} ||
          CASE event_id % 4 WHEN 0 THEN ' GLENDALE' WHEN 1 THEN ', TEMPE, AZ, 85283' ELSE '' END
          END AS situs_address,
        props AS raw, ts::DATE AS observed_date, ts AS created_at
      FROM (SELECT *, {PARCEL} AS parcel, CASE event_type WHEN 'error' THEN 'recorder_nots'
               WHEN 'click' THEN CASE event_id % 5 WHEN 0 THEN 'recorder_ml' WHEN 1 THEN 'recorder_nl'
                                 ELSE 'recorder_lp' END
               WHEN 'view' THEN {pick(["code_glendale", "code_tempe", "phoenix_code", "code_county"], 'event_id')}
               WHEN 'purchase' THEN 'treasurer_delinquent'
               ELSE CASE WHEN event_id % 2 = 0 THEN 'court_probate' ELSE 'court_divorce' END END AS src
            FROM ev)""",
    "runs": f"""
      SELECT strftime(day, '%Y-%m-%d') || '/' || source AS id, source,
        day + INTERVAL 803 MINUTE AS started_at, day + INTERVAL 843 MINUTE AS finished_at,
        CASE WHEN mark = 5 THEN 0 ELSE n END AS rows_found, n7 AS rows_new,
        CASE mark WHEN 3 THEN 'warn' WHEN 7 THEN 'error' ELSE 'ok' END AS status,
        CASE mark WHEN 7 THEN 'timeout' WHEN 9 THEN 'busy-stop' END AS error
      FROM (SELECT *, (dayofmonth(day) + length(source)) % 11 AS mark
            FROM (SELECT ts::DATE AS day, {case_of('event_type', S.LOG_SOURCES)} AS source,
                         count(*)::INT AS n, count_if(event_id % 7 = 0)::INT AS n7
                  FROM events GROUP BY 1, 2))""",
    "prospects": f"""
      SELECT s_suppkey AS id,
        CASE WHEN s_suppkey % 41 <> 0 THEN ((s_suppkey * 37) % 1009 + 1)::INT END AS rank,
        {cap(surname('s_suppkey'))} ||
          {pick([" LLC", " – Homes", ", Inc.", " (West)", " Group", "s"], 's_suppkey')} AS company,
        CASE WHEN s_suppkey % 9 <> 0 THEN {cap(forename('s_suppkey'))} || ' ' ||
          {cap(surname('s_suppkey'))} END AS contact_name,
        CASE WHEN s_suppkey % 13 <> 0 THEN
          {pick(["lender", "flipper", "wholesaler", "community_leader", "lender"], 's_nationkey')}
          END AS segment,
        CASE WHEN s_suppkey % 8 <> 0 THEN
          CASE s_suppkey % 6 WHEN 0 THEN 'info' WHEN 1 THEN 'Sales+west'
               ELSE lower({forename('s_suppkey')}) || '.' || lower({surname('s_suppkey')}) END
          || '@' || CASE WHEN s_suppkey % 7 = 0 THEN 'forms.example'
                    ELSE 'firm' || s_suppkey::VARCHAR || '.example' END END AS email,
        '555-' || lpad(s_suppkey::VARCHAR, 4, '0') AS phone,
        CASE WHEN s_suppkey % 11 = 0 THEN ''
             WHEN s_suppkey % 2 = 0 THEN 'https://www.firm' || s_suppkey::VARCHAR || '.example/about'
             ELSE 'firm' || s_suppkey::VARCHAR || '.example' END AS url,
        CASE s_suppkey % 3 WHEN 0 THEN 'Office: ' || {house('s_suppkey')} || ', ' ||
               {pick([' '.join(w.capitalize() for w in c.split(' ')) for c in S.CITIES], 's_suppkey')}
               || ', AZ ' || (85000 + s_suppkey % 300)::VARCHAR
             WHEN 1 THEN 'HQ: 1 High St, Columbus, OH 43220' END AS notes,
        {pick(["new", "new", "new", "sent", "replied", "stop", "trial"], 's_suppkey')} AS status,
        CASE WHEN s_suppkey % 4 = 0 THEN (85000 + s_suppkey % 300)::VARCHAR || ' , ' ||
             (85000 + (s_suppkey + 1) % 300)::VARCHAR END AS zips,
        CASE WHEN s_suppkey % 5 < 2 THEN
          {pick([' '.join(w.capitalize() for w in c.split(' ')) for c in S.CITIES], 's_suppkey')}
          || ',' || {pick(S.CITIES, 's_suppkey + 2')} END AS cities,
        CASE WHEN s_suppkey % 2 = 0 THEN {pick(K.VARIANTS, 's_suppkey // 2')} END AS subject_variant,
        CASE WHEN s_suppkey % 10 = 0 THEN 'code' || lpad(s_suppkey::VARCHAR, 4, '0') END AS link_code
      FROM supplier""",
    "outreach": f"""
      SELECT event_id AS id, CASE WHEN event_id % 37 <> 0 THEN user_id END AS prospect_id,
        event_id % 2 + 1 AS campaign_id,
        CASE WHEN user_id % 5 < 4 THEN {pick(K.VARIANTS, 'user_id')} END AS variant,
        CASE event_type WHEN 'signup' THEN 'sent' WHEN 'view' THEN 'opened' WHEN 'click' THEN 'clicked'
          WHEN 'purchase' THEN {pick(["replied", "trial", "paid"], 'event_id // 5')}
          ELSE CASE WHEN event_id % 9 = 0 THEN 'stop' WHEN event_id % 9 < 3 THEN 'bounced'
               ELSE 'sent' END END AS event,
        CASE WHEN event_type = 'click' THEN k END AS click_k, ts AS created_at
      FROM ev""",
    "pages_raw": f"""
      SELECT event_id AS id, 'v' || user_id::VARCHAR AS vid,
        CASE WHEN event_id % 7 <> 0 THEN user_id END AS prospect_id,
        's' || user_id::VARCHAR || '-' || strftime(ts, '%Y-%m-%d') AS session_id,
        CASE WHEN event_id % 19 <> 0 THEN
          {pick(["/report", "/report?window=7d", "/admin/x", "/", "/pricing", "/dossier"], 'event_id // 3')}
          END AS path,
        CASE event_type WHEN 'purchase' THEN 'engaged_time'
          WHEN 'click' THEN {pick(["row_expand", "export_click", "cta_click"], 'k')}
          WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN '   ' ELSE 'pageview' END
          ELSE ' pageview ' END AS event,
        props AS meta, CASE WHEN event_type = 'purchase' THEN value * 1000 END AS ms,
        ts AS created_at
      FROM ev""",
    "page_events": """
      SELECT id, vid, prospect_id, session_id, coalesce(path, '/') AS path, trim(event) AS event, meta,
             floor(ms + 0.5)::BIGINT AS ms, created_at
      FROM pages_raw
      WHERE trim(event) <> '' AND NOT starts_with(coalesce(path, '/'), '/admin')""",
    "latest_types": """
      SELECT apn, signal_type, max(coalesce(event_date, created_at::DATE)) AS latest_date
      FROM signals WHERE apn IS NOT NULL GROUP BY 1, 2""",
    "type_terms": f"""
      SELECT *, decayed_raw >= 0.25 * base AND base > 0 AS live,
        CASE WHEN signal_type = 'trustee_sale' AND days_out < 0 THEN decayed_raw * 0.25
             ELSE decayed_raw END AS decayed,
        CASE WHEN signal_type <> 'trustee_sale' THEN 0 WHEN days_out BETWEEN 0 AND 30 THEN 20
             WHEN days_out BETWEEN 31 AND 60 THEN 10 ELSE 0 END AS bonus
      FROM (SELECT *, CASE WHEN age_days <= 730 THEN base * pow(0.5, age_days / half_life)
                           ELSE 0 END AS decayed_raw
            FROM (SELECT *, {case_of('signal_type', K.TYPE_WEIGHTS, '0')} AS base,
                    {case_of('signal_type', K.HALF_LIFE_DAYS, '180')}::DOUBLE AS half_life,
                    greatest(0, date_diff('day', latest_date, {TODAY})) AS age_days,
                    date_diff('day', {TODAY}, latest_date + 90) AS days_out
                  FROM latest_types))""",
    "scores": f"""
      SELECT apn, floor(total + 0.5)::INT AS score,
        floor(total + 0.5) >= 60 OR live_count >= 2 AS hot, types, live_count, fresh, absentee,
        high_equity, long_tenure, latest_date, min_age
      FROM (SELECT *, dec_sum + bonus + 15 * greatest(live_count - 1, 0)
              + CASE WHEN absentee THEN 10 ELSE 0 END + CASE WHEN high_equity THEN 10 ELSE 0 END
              + CASE WHEN long_tenure THEN 5 ELSE 0 END + CASE WHEN fresh THEN 10 ELSE 0 END AS total
        FROM (SELECT t.*, coalesce(p.absentee, false) AS absentee, min_age <= 7 AS fresh,
                p.assessed_value IS NOT NULL AND (p.last_sale_date IS NULL
                  OR p.last_sale_date < {AS_OF} - INTERVAL 10 YEAR) AS high_equity,
                p.last_sale_date IS NULL OR p.last_sale_date < {AS_OF} - INTERVAL 15 YEAR AS long_tenure
              FROM (SELECT apn, sum(decayed ORDER BY signal_type) AS dec_sum, sum(bonus) AS bonus,
                      count_if(live) AS live_count, min(age_days) AS min_age,
                      max(latest_date) AS latest_date,
                      string_agg(signal_type, ',' ORDER BY signal_type) AS types
                    FROM type_terms GROUP BY apn) t
              JOIN properties p USING (apn)))""",
    "parcel_types": """
      SELECT apn, count(DISTINCT signal_type)::INT AS stacked_types,
        string_agg(DISTINCT signal_type, ',' ORDER BY signal_type) AS signal_types,
        max(event_date) FILTER (signal_type = 'trustee_sale') AS trustee_date
      FROM signals WHERE apn IS NOT NULL GROUP BY apn""",
    "index_parts": _name_parts("properties", "apn", "owner_name", "owner_name IS NOT NULL"),
    "name_index": f"""
      SELECT key, apn, arg_min(mid, pos) AS middle FROM (
        SELECT apn, pos, CASE WHEN len(full_words) >= 2 THEN full_words[1] ELSE prev END || '|' ||
            CASE WHEN len(full_words) >= 2 THEN full_words[2] ELSE full_words[1] END AS key,
          coalesce(CASE WHEN len(full_words) >= 2 THEN full_words[3] END, initials[1], '') AS mid
        FROM (SELECT *, coalesce(
                last_value(CASE WHEN len(full_words) >= 2 THEN full_words[1] END IGNORE NULLS) OVER w,
                first_value(CASE WHEN len(full_words) = 1 THEN full_words[1] END IGNORE NULLS) OVER w
              ) AS prev
              FROM index_parts
              WINDOW w AS (PARTITION BY apn ORDER BY pos
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        WHERE len(full_words) >= 2 OR (len(full_words) = 1 AND prev IS NOT NULL)
        UNION ALL
        SELECT apn, 1, {entity_key(name_norm('owner_name'))}, '' FROM properties
        WHERE owner_name IS NOT NULL AND {is_entity_name(name_norm('owner_name'))})
      WHERE key IS NOT NULL GROUP BY key, apn""",
    "open_names": f"""
      SELECT DISTINCT owner_name FROM signals
      WHERE apn IS NULL AND owner_name IS NOT NULL AND source IN ({', '.join(q(s) for s in K.NAME_SOURCES)})""",
    "name_parts": _name_parts("open_names", "owner_name", "owner_name", "true"),
    "name_keys": f"""
      SELECT owner_name, key, min(ord) AS ord FROM (
        SELECT owner_name, pos * 2 AS ord, full_words[1] || '|' || full_words[2] AS key
        FROM name_parts WHERE len(full_words) >= 2
        UNION ALL
        SELECT owner_name, pos * 2 + 1, full_words[-1] || '|' || full_words[1]
        FROM name_parts WHERE len(full_words) >= 2
        UNION ALL
        SELECT owner_name, 1, {entity_key(name_norm('owner_name'))} FROM open_names
        WHERE {is_entity_name(name_norm('owner_name'))})
      WHERE key IS NOT NULL GROUP BY 1, 2""",
    "name_mids": """
      SELECT DISTINCT owner_name, m[1] AS m FROM (
        SELECT owner_name, unnest(list_concat(
          CASE WHEN len(full_words) >= 3 THEN [full_words[3], full_words[2]] ELSE [] END,
          initials)) AS m FROM name_parts WHERE len(full_words) >= 2)""",
    "name_hits": """
      SELECT k.owner_name, i.apn, arg_max(i.middle, k.ord) AS middle,
             coalesce(NOT any_value(p.absentee), false) AS home
      FROM name_keys k JOIN name_index i USING (key) JOIN properties p ON p.apn = i.apn
      GROUP BY 1, 2""",
    "name_decisions": """
      SELECT n.owner_name,
        CASE WHEN c = 1 THEN apns[1] WHEN m = 1 THEN m_apns[1]
             WHEN m > 1 THEN CASE WHEN mh = 1 THEN mh_apns[1] END
             WHEN h = 1 THEN h_apns[1] END AS apn,
        CASE WHEN coalesce(c, 0) = 0 THEN 'none' WHEN c = 1 AND m = 1 THEN 'exact' WHEN c = 1 OR m = 1 THEN 'probable'
             WHEN m > 1 THEN CASE WHEN mh = 1 THEN 'likely' ELSE 'ambiguous' END
             WHEN h = 1 THEN 'likely' ELSE 'ambiguous' END AS confidence,
        coalesce(CASE WHEN c > 1 AND m > 1 THEN m ELSE c END, 0) AS n_candidates,
        coalesce(array_to_string(CASE WHEN c > 1 AND m > 1 THEN m_apns ELSE apns END, ','), '') AS candidates
      FROM open_names n LEFT JOIN (
        SELECT owner_name, count(*) AS c, count_if(ok) AS m, count_if(home) AS h,
          count_if(ok AND home) AS mh,
          list(apn ORDER BY apn)[1:20] AS apns,
          (list(apn ORDER BY apn) FILTER (ok))[1:20] AS m_apns,
          (list(apn ORDER BY apn) FILTER (home))[1:20] AS h_apns,
          (list(apn ORDER BY apn) FILTER (ok AND home))[1:20] AS mh_apns
        FROM (SELECT h.*, EXISTS (SELECT 1 FROM name_mids m WHERE m.owner_name = h.owner_name
                                  AND m.m = h.middle[1]) AS ok FROM name_hits h)
        GROUP BY 1) d USING (owner_name)""",
    "name_resolved": f"""
      SELECT s.source, s.external_id, d.apn, d.confidence, 'keys' AS method, d.n_candidates, d.candidates
      FROM signals s JOIN name_decisions d USING (owner_name)
      WHERE s.apn IS NULL AND s.source IN ({', '.join(q(s) for s in K.NAME_SOURCES)})""",
    "address_resolved": f"""
      SELECT s.source, s.external_id, CASE WHEN c = 1 THEN apns[1] END AS apn,
        CASE WHEN coalesce(c, 0) = 0 THEN 'none' WHEN c = 1 THEN 'exact' ELSE 'ambiguous' END AS confidence,
        'address' AS method, coalesce(c, 0) AS n_candidates,
        coalesce(array_to_string(apns, ','), '') AS candidates
      FROM (SELECT *, {street_only('situs_address')} AS street FROM signals
            WHERE apn IS NULL AND situs_address IS NOT NULL
              AND source IN ({', '.join(q(s) for s in K.ADDRESS_SOURCES)})) s
      LEFT JOIN (SELECT {norm_address('situs_address')} AS street, count(*) AS c,
                   list(apn ORDER BY apn)[1:20] AS apns
                 FROM properties GROUP BY 1) p
        ON p.street = s.street AND length(s.street) >= 4""",
}


def report_sql(hours: int, filed: str = "true", homeowners: bool = True) -> str:
    """Report rows before ranking, written with QUALIFY and one lookup per parcel."""
    keep = f"WHERE owner_name IS NOT NULL AND NOT {entity_owner('owner_name')}" if homeowners else ""
    return f"""
      SELECT *, {entity_owner('owner_name')} AS is_entity FROM (
        SELECT f.apn, f.signal_type, f.source, f.external_id, f.source_url, f.event_date, f.created_at,
          coalesce(p.owner_name, f.owner_name) AS owner_name, p.situs_address, p.situs_city,
          p.situs_zip, sc.score, sc.hot AS is_hot,
          CASE WHEN f.apn IS NULL THEN 0 ELSE t.stacked_types END AS stacked_types,
          CASE WHEN f.apn IS NULL THEN f.signal_type ELSE t.signal_types END AS signal_types,
          p.mailing_address, p.absentee, p.assessed_value, p.last_sale_price, p.last_sale_date,
          (floor(date_diff('day', p.last_sale_date, {TODAY}) / 365))::INT AS years_owned,
          (CASE WHEN f.apn IS NOT NULL THEN t.trustee_date
                WHEN f.signal_type = 'trustee_sale' THEN f.event_date END) + 90 AS est_auction_date
        FROM (SELECT * FROM signals
              WHERE created_at > {AS_OF} - INTERVAL {hours} HOUR AND {filed}
              QUALIFY row_number() OVER (
                PARTITION BY apn, CASE WHEN apn IS NULL THEN coalesce('o' || owner_name, '') || '/' || signal_type END
                ORDER BY event_date DESC NULLS LAST, created_at DESC, source, external_id) = 1) f
        LEFT JOIN properties p ON p.apn = f.apn
        LEFT JOIN scores sc ON sc.apn = f.apn
        LEFT JOIN parcel_types t ON t.apn = f.apn)
      {keep}"""


REPORT_ORDER = ("score DESC NULLS LAST, created_at DESC, apn NULLS LAST, owner_name NULLS LAST, "
                "signal_type")
FILED_14D = f"event_date >= {PHX_TODAY} - 14"

TABLES["pool"] = f"""
      SELECT *, (row_number() OVER (ORDER BY {REPORT_ORDER}))::INT AS pos
      FROM (SELECT * FROM ({report_sql(168, FILED_14D)}) ORDER BY {REPORT_ORDER} LIMIT 400)
      WHERE apn <> '' AND situs_address <> ''"""


def with_tables(sql: str) -> str:
    """Put the CTEs the text refers to in front of it, in order of definition."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, body in TABLES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(body)

    visit(sql)
    ctes = ",\n".join(f"{n} AS ({TABLES[n]})" for n in TABLES if n in needed)
    if not ctes:
        return sql
    own = re.match(r"\s*WITH (RECURSIVE )?", sql)
    if own:
        return f"WITH {own.group(1) or ''}{ctes},\n{sql[own.end():]}"
    return f"WITH {ctes}\n{sql}"
