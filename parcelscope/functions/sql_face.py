"""The scalar functions of this package as SQL functions.

`register(spark)` creates one temporary SQL function for each; its body is a SQL expression that the
analyzer puts in place of the call, so a query over them has the plan of the expressions written out:
no Python, and filters on them reach the scan as far as Spark can push them. Bodies call each other by
name, but not inside lambdas, where Spark takes no SQL function.

The word lists and patterns are those of `constants`. tests/test_sql_face.py holds every function
against its Column twin.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from . import constants as K
from .text import _CITY_TAIL, _UNIT_TAIL, any_word


def _r(pattern: str) -> str:
    """A pattern as a raw SQL string."""
    mark = "'" if "'" not in pattern else '"'
    if mark in pattern:
        raise ValueError(f"both quotes in {pattern}")
    return f"r{mark}{pattern}{mark}"


def _s(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _in(values) -> str:
    return "(" + ", ".join(_s(v) if isinstance(v, str) else str(v) for v in values) + ")"


def _look_up(values: dict, key: str) -> str:
    entries = ", ".join(f"{_s(k)}, {_s(v)}" for k, v in values.items())
    return f"try_element_at(map({entries}), {key})"


_ENDS = r"' \t\n\r\u000C\u000B\u00A0'"
_LOW, _CAP = "'abcdefghijklmnopqrstuvwxyz'", "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
_PERSONS = "ARRAY<STRUCT<last: STRING, first: STRING, middle: STRING>>"
_SIGNAL = "ARRAY<STRUCT<type: STRING, external_id: STRING, source_url: STRING>>"
_NO_STRINGS = "cast(array() as ARRAY<STRING>)"


def _stripped(x: str) -> str:
    return f"trim(BOTH {_ENDS} FROM {x})"


def _ascii_capital(x: str) -> str:
    return f"concat(translate(substring({x}, 1, 1), {_LOW}, {_CAP}), substring({x}, 2))"


def _alias(token: str) -> str:
    return f"CASE {token} " + " ".join(f"WHEN {_s(a)} THEN {_s(b)}" for a, b in K.STREET_WORD_ALIASES.items()) + f" ELSE {token} END"


def _ago(n: str, unit: str) -> str:
    return f"concat({n}, CASE WHEN {n} = 1 THEN ' {unit} ago' ELSE ' {unit}s ago' END)"


_TRUST = r"(?i)\b(TRUST|TRUSTEES?)\b|\bESTATE OF\b"
_DIGITS = r"^\d+$"
_CUT = r"(?s)( – | - | \(|,).*$"
_SUFFIX = rf"(?i)[,\s]+({'|'.join(K.COMPANY_SUFFIXES)})\.?$"
_SPACES = r"\s+"

#: name, parameters, result, body; helpers first, then in the order of the modules
FUNCTIONS: list[tuple[str, str, str, str]] = [
    # --- text ---
    ("strip_ends", "s STRING", "STRING", _stripped("s")),
    ("blank_to_null", "s STRING", "STRING", "nullif(strip_ends(s), '')"),
    ("squeeze", "s STRING", "STRING", f"trim(regexp_replace(s, {_r(_SPACES)}, ' '))"),
    ("split_words", "s STRING", "ARRAY<STRING>", f"filter(split(s, {_r(_SPACES)}), t -> t <> '')"),
    ("normalize_apn", "s STRING", "STRING", "regexp_replace(upper(coalesce(s, '')), '[^0-9A-Z]', '')"),
    ("normalize_owner_name", "s STRING", "STRING",
     f"squeeze(regexp_replace(regexp_replace(upper(coalesce(s, '')), '[.,]', ' '), {_r(any_word(K.OWNER_NOISE_WORDS))}, ' '))"),
    ("normalize_address", "s STRING", "STRING", "squeeze(regexp_replace(upper(coalesce(s, '')), '[.,#]', ' '))"),
    ("street_only", "s STRING", "STRING", f"normalize_address(regexp_replace(strip_ends(upper(coalesce(s, ''))), {_r(_CITY_TAIL)}, ''))"),
    ("sorted_name_key", "s STRING", "STRING", "array_join(array_sort(split_words(normalize_owner_name(s))), ' ')"),
    ("address_words", "s STRING", "ARRAY<STRING>",
     f"split_words(regexp_replace(concat(' ', regexp_replace(regexp_replace(upper(coalesce(s, '')), '[.,]', ' '), '#', ' # '), ' '), {_r(_UNIT_TAIL)}, ''))"),
    ("address_match_key", "s STRING", "STRING",
     f"array_join(filter(transform(filter(address_words(s), t -> t NOT IN {_in(K.DIRECTIONALS)}), t -> {_alias('t')}), "
     f"t -> t NOT IN {_in(K.STREET_TYPES)}), ' ')"),
    ("zip5", "s STRING", "STRING", r"nullif(regexp_extract(s, r'\d{5}', 0), '')"),
    ("same_place", "city_a STRING, zip_a STRING, city_b STRING, zip_b STRING", "BOOLEAN",
     "CASE WHEN city_a IS NOT NULL AND city_b IS NOT NULL THEN city_a = city_b ELSE coalesce(zip_a = zip_b, true) END"),
    ("same_key", "key_a STRING, key_b STRING", "BOOLEAN", "key_a <> '' AND key_a = key_b"),
    ("same_street_address", "addr_a STRING, city_a STRING, zip_a STRING, addr_b STRING, city_b STRING, zip_b STRING", "BOOLEAN",
     "same_key(address_match_key(addr_a), address_match_key(addr_b)) AND "
     "same_place(blank_to_null(upper(city_a)), zip5(zip_a), blank_to_null(upper(city_b)), zip5(zip_b))"),
    ("absentee_flag", "mail_line STRING, mail_city STRING, mail_zip STRING, situs_line STRING, situs_city STRING, situs_zip STRING", "BOOLEAN",
     "blank_to_null(mail_line) IS NOT NULL AND blank_to_null(situs_line) IS NOT NULL AND "
     "NOT coalesce(same_street_address(mail_line, mail_city, mail_zip, situs_line, situs_city, situs_zip), false)"),
    ("compose_mailing_address", "line1 STRING, line2 STRING, city STRING, state STRING, zip STRING", "STRING",
     "nullif(concat_ws(', ', blank_to_null(line1), blank_to_null(line2), blank_to_null(city), blank_to_null(state), blank_to_null(zip)), '')"),
    ("street_with_unit", "street STRING, unit STRING", "STRING",
     "nullif(CASE WHEN unit <> '' AND upper(coalesce(try_element_at(split_words(street), -1), '')) <> upper(unit) "
     "THEN concat(street, ' ', unit) ELSE street END, '')"),
    ("compose_situs_address", "line STRING, suite STRING", "STRING", "street_with_unit(strip_ends(coalesce(line, '')), strip_ends(coalesce(suite, '')))"),
    ("parse_legal_class", "s STRING", "STRING", r"nullif(regexp_extract(s, r'\d+%\s*([^\s;,]+)', 1), '')"),
    ("number_of", "s STRING", "DOUBLE", r"CASE WHEN s RLIKE r'^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$' THEN try_cast(s AS DOUBLE) END"),
    ("finite", "x DOUBLE", "DOUBLE", "CASE WHEN abs(x) < double('Infinity') THEN nullif(x, 0D) END"),
    ("numeric_or_null", "s STRING", "DOUBLE", "finite(number_of(strip_ends(s)))"),
    ("year_built", "s STRING", "INT", r"CASE WHEN strip_ends(s) RLIKE r'^\d{4}$' THEN try_cast(strip_ends(s) AS INT) END"),
    ("csv_list", "s STRING", "ARRAY<STRING>", f"filter(transform(split(coalesce(s, ''), ','), t -> {_stripped('t')}), t -> t <> '')"),
    ("is_entity_owner", "s STRING", "BOOLEAN",
     f"s RLIKE {_r(any_word(K.REPORT_ENTITY_WORDS, '(?i)'))} OR trim(s) RLIKE {_r('(?i)^(' + '|'.join(K.PLACEHOLDER_OWNERS) + ')$')}"),
    ("is_institution", "s STRING", "BOOLEAN", f"s RLIKE {_r(any_word(K.INSTITUTION_PATTERNS, '(?i)'))}"),
    ("pick_document_owner", "names ARRAY<STRING>", "STRING",
     f"blank_to_null(coalesce(get(filter(names, n -> NOT n RLIKE {_r(any_word(K.INSTITUTION_PATTERNS, '(?i)'))}), 0), get(names, 0)))"),
    ("email_domain", "s STRING", "STRING",
     "CASE WHEN instr(coalesce(s, ''), '@') = 0 THEN 'unknown' ELSE lower(substring_index(s, '@', -1)) END"),
    # --- dates ---
    ("phoenix_date", "ts TIMESTAMP", "DATE", "to_date(from_utc_timestamp(ts, 'America/Phoenix'))"),
    ("phoenix_day_bounds", "ts TIMESTAMP", "STRUCT<start: TIMESTAMP, end: TIMESTAMP>",
     "named_struct('start', to_utc_timestamp(cast(phoenix_date(ts) AS TIMESTAMP), 'America/Phoenix'), "
     "'end', to_utc_timestamp(cast(date_add(phoenix_date(ts), 1) AS TIMESTAMP), 'America/Phoenix'))"),
    ("parse_us_date", "s STRING", "DATE",
     r"cast(try_to_timestamp(nullif(regexp_extract(s, r'^\s*(\d{1,2}/\d{1,2}/\d{4})(\s|$)', 1), ''), 'M/d/yyyy') AS DATE)"),
    ("since_1900", "d DATE", "DATE", "CASE WHEN year(d) >= 1900 THEN d END"),
    ("parse_deed_date", "s STRING", "DATE", r"since_1900(cast(try_to_timestamp(CASE WHEN s RLIKE r'^\d{8}$' THEN s END, 'MMddyyyy') AS DATE))"),
    ("month_of_words", "w ARRAY<STRING>", "DATE",
     r"cast(try_to_timestamp(CASE WHEN size(w) = 2 AND get(w, 0) RLIKE r'^\d{1,2}$' AND get(w, 1) RLIKE r'^\d{4}$' "
     "THEN concat_ws('-', get(w, 1), lpad(get(w, 0), 2, '0'), '01') END, 'yyyy-MM-dd') AS DATE)"),
    ("parse_sale_date", "s STRING", "DATE", f"month_of_words(split(trim(s), {_r(_SPACES)}))"),
    ("age_in_days", "d DATE, as_of TIMESTAMP", "BIGINT",
     "CASE WHEN d IS NOT NULL AND as_of IS NOT NULL THEN greatest(0L, floor((unix_seconds(as_of) - unix_seconds(cast(d AS TIMESTAMP))) / 86400)) END"),
    ("years_owned", "sale_date DATE, as_of TIMESTAMP", "INT", "cast(floor(datediff(to_date(as_of), sale_date) / 365) AS INT)"),
    ("est_auction_date", "d DATE", "DATE", f"date_add(d, {K.AUCTION_NOTICE_DAYS})"),
    ("days_to_auction", "d DATE, as_of TIMESTAMP", "INT", "datediff(d, to_date(as_of))"),
    ("in_days", "n INT", "STRING", "CASE WHEN n = 0 THEN 'today' WHEN n > 0 THEN concat('in ', n, 'd') ELSE concat(abs(n), 'd ago') END"),
    ("auction_cell", "d DATE, as_of TIMESTAMP", "STRING", "coalesce(concat(cast(d AS STRING), ' est · ', in_days(days_to_auction(d, as_of))), '-')"),
    ("short_date", "d DATE", "STRING", "date_format(d, 'MMM d')"),
    ("days_ago", "n BIGINT", "STRING",
     f"CASE WHEN n < 1 THEN 'today' WHEN n < 14 THEN {_ago('n', 'day')} WHEN floor(n / 7) < 6 THEN {_ago('floor(n / 7)', 'week')} "
     f"WHEN floor(n / 30) < 12 THEN {_ago('floor(n / 30)', 'month')} WHEN n IS NOT NULL THEN {_ago('floor(n / 365)', 'year')} END"),
    ("relative_time", "ts TIMESTAMP, as_of TIMESTAMP", "STRING", "days_ago(floor((unix_seconds(as_of) - unix_seconds(ts)) / 86400))"),
    ("date_chunks", "first DATE, last DATE, n INT", "ARRAY<STRUCT<chunk_start: DATE, chunk_end: DATE>>",
     "CASE WHEN first <= last THEN transform(sequence(0, cast(floor(datediff(last, first) / n) AS INT)), "
     "i -> named_struct('chunk_start', date_add(first, i * n), 'chunk_end', least(date_add(first, i * n + n - 1), last))) END"),
    # --- names ---
    ("name_normalize", "s STRING", "STRING",
     r"squeeze(regexp_replace(regexp_replace(upper(coalesce(s, '')), r'\bAND\b', '&'), " + r"""concat(r'[.,"()\-', "'", r']+'), ' '))"""),
    ("is_entity_norm", "s STRING", "BOOLEAN", f"s = '' OR s RLIKE {_r(any_word(K.NAME_ENTITY_PATTERNS))}"),
    ("is_entity_name", "s STRING", "BOOLEAN", "is_entity_norm(name_normalize(s))"),
    ("person_tokens", "part STRING", "ARRAY<STRING>",
     f"filter(split(part, ' '), t -> t <> '' AND t NOT IN {_in(K.NAME_NOISE_WORDS)} AND NOT t RLIKE {_r(_DIGITS)})"),
    ("name_parts", "s STRING", "ARRAY<STRUCT<full: ARRAY<STRING>, initials: ARRAY<STRING>>>",
     f"transform(transform(filter(split(s, r'\\s*[/&]\\s*'), p -> p <> ''), "
     f"p -> filter(split(p, ' '), t -> t <> '' AND t NOT IN {_in(K.NAME_NOISE_WORDS)} AND NOT t RLIKE {_r(_DIGITS)})), "
     "w -> named_struct('full', filter(w, t -> length(t) > 1), 'initials', filter(w, t -> length(t) = 1)))"),
    ("persons_of_norm", "s STRING", _PERSONS,
     f"CASE WHEN is_entity_norm(s) THEN cast(array() AS {_PERSONS}) ELSE "
     f"aggregate(name_parts(s), named_struct('last', cast(NULL AS STRING), 'persons', cast(array() AS {_PERSONS})), (acc, p) -> named_struct("
     "'last', CASE WHEN size(p.full) = 0 OR (size(p.full) = 1 AND acc.last IS NOT NULL) THEN acc.last ELSE get(p.full, 0) END, "
     "'persons', CASE WHEN size(p.full) = 1 AND acc.last IS NOT NULL "
     "THEN concat(acc.persons, array(named_struct('last', acc.last, 'first', get(p.full, 0), 'middle', get(p.initials, 0)))) "
     "WHEN size(p.full) >= 2 THEN concat(acc.persons, array(named_struct('last', get(p.full, 0), 'first', get(p.full, 1), "
     "'middle', coalesce(get(p.full, 2), get(p.initials, 0))))) ELSE acc.persons END), acc -> acc.persons) END"),
    ("persons_from_owner", "s STRING", _PERSONS, "persons_of_norm(name_normalize(s))"),
    ("property_keys", "s STRING", "ARRAY<STRING>", "array_distinct(transform(persons_from_owner(s), p -> concat(p.last, '|', p.first)))"),
    ("signal_keys_of_norm", "s STRING", "ARRAY<STRING>",
     f"CASE WHEN is_entity_norm(s) THEN {_NO_STRINGS} ELSE array_distinct(flatten(transform(filter(name_parts(s), p -> size(p.full) >= 2), "
     "p -> array(concat(get(p.full, 0), '|', get(p.full, 1)), concat(try_element_at(p.full, -1), '|', get(p.full, 0)))))) END"),
    ("signal_keys", "s STRING", "ARRAY<STRING>", "signal_keys_of_norm(name_normalize(s))"),
    ("entity_key_of", "s STRING", "STRING", "CASE WHEN length(s) >= 4 THEN concat('=', s) END"),
    ("entity_key", "s STRING", "STRING", r"entity_key_of(squeeze(regexp_replace(name_normalize(s), r'\bTHE\b', '')))"),
    # --- labels and cells ---
    ("title_case", "s STRING", "STRING",
     r"array_join(transform(regexp_extract_all(lower(s), r'\s+|/|&|[^\s/&]+', 0), t -> "
     f"CASE WHEN regexp_replace(upper(t), '[^A-Z]', '') IN {_in(K.KEEP_UPPER)} THEN upper(t) ELSE array_join(transform("
     'regexp_extract_all(t, r"[-\']?[^-\']+|[-\']", 0), p -> '
     f"CASE WHEN substring(p, 1, 1) IN ('-', \"'\") THEN concat(substring(p, 1, 1), {_ascii_capital('substring(p, 2)')}) "
     f"ELSE {_ascii_capital('p')} END), '') END), '')"),
    ("without_repeated_end", "w ARRAY<STRING>", "ARRAY<STRING>",
     "CASE WHEN size(w) > 0 THEN slice(w, 1, coalesce(array_max(filter(sequence(1, size(w)), "
     "i -> upper(get(w, i - 1)) <> upper(try_element_at(w, -1)))), 0) + 1) ELSE w END"),
    ("marked_unit_at", "w ARRAY<STRING>, place INT", "STRING",
     "CASE WHEN place = 0 OR place = size(w) THEN array_join(w, ' ') "
     "ELSE concat(array_join(slice(w, 1, place), ' '), ' #', array_join(slice(w, place + 1, size(w)), ' ')) END"),
    ("marked_unit", "w ARRAY<STRING>", "STRING",
     "CASE WHEN size(w) > 0 THEN marked_unit_at(w, coalesce(array_max(filter(sequence(1, size(w)), "
     f"i -> upper(get(w, i - 1)) IN {_in(K.STREET_TYPES)})), 0)) ELSE '' END"),
    ("format_situs_address", "s STRING", "STRING", "CASE WHEN s IS NOT NULL THEN marked_unit(without_repeated_end(split_words(s))) END"),
    ("list_sentence", "items ARRAY<STRING>", "STRING",
     "CASE WHEN size(items) <= 1 THEN array_join(items, '') ELSE concat(array_join(slice(items, 1, size(items) - 1), ', '), ' and ', try_element_at(items, -1)) END"),
    ("capital_first", "s STRING", "STRING", "concat(upper(substring(s, 1, 1)), substring(s, 2))"),
    ("label_signal_types", "s STRING", "STRING",
     f"capital_first(array_join(transform(array_distinct(csv_list(s)), t -> coalesce({_look_up(K.PITCH_LABELS, 't')}, regexp_replace(t, '_', ' '))), ' + '))"),
    ("has_signal_type", "types STRING, t STRING", "BOOLEAN", "array_contains(csv_list(types), t)"),
    ("lead_key", "apn STRING, owner_name STRING, signal_type STRING, situs_address STRING", "STRING",
     "coalesce(apn, concat_ws('|', coalesce(owner_name, ''), coalesce(signal_type, ''), coalesce(situs_address, '')))"),
    ("pitch_place", "street STRING, city STRING, zip STRING", "STRING",
     "coalesce(nullif(concat_ws(' ', nullif(concat_ws(', ', nullif(street, ''), nullif(city, '')), ''), nullif(zip, '')), ''), '(address unresolved)')"),
    ("build_pitch_line", "types STRING, situs_address STRING, situs_city STRING, situs_zip STRING, years INT, absentee BOOLEAN", "STRING",
     "concat_ws(' · ', nullif(label_signal_types(types), ''), "
     "pitch_place(title_case(format_situs_address(nullif(situs_address, ''))), title_case(nullif(situs_city, '')), situs_zip), "
     "concat('owned ', years, ' yrs'), CASE WHEN absentee THEN 'absentee' ELSE 'owner-occupied' END)"),
    ("money_k", "x DOUBLE", "STRING", "coalesce(concat('$', cast(floor(x / 1000 + 0.5D) AS BIGINT), 'k'), '-')"),
    ("beyond_middle", "x DOUBLE, high DOUBLE, below BIGINT", "DOUBLE", "(high * 20 - (2 * below + 1)) + (x - high) * 20"),
    ("to_tenths", "below BIGINT, beyond DOUBLE", "BIGINT", "below + CASE WHEN beyond > 0 OR (beyond = 0 AND below % 2 = 1) THEN 1 ELSE 0 END"),
    ("with_point", "tenths BIGINT", "STRING", "concat(cast(tenths div 10 AS STRING), '.', cast(tenths % 10 AS STRING))"),
    ("one_decimal", "x DOUBLE", "STRING",
     "CASE WHEN x < 1e14D THEN with_point(to_tenths(floor(x * 10), beyond_middle(x, x * 134217729D - (x * 134217729D - x), floor(x * 10)))) "
     "ELSE format_string('%.1f', x) END"),
    ("fmt_money", "x DOUBLE", "STRING",
     "CASE WHEN x >= 1000000 THEN concat('$', one_decimal(x / 1000000), 'm') "
     "WHEN x IS NOT NULL THEN concat('$', cast(floor(x / 1000 + 0.5D) AS BIGINT), 'k') END"),
    ("split_owner_words", "raw STRING, w ARRAY<STRING>, is_entity BOOLEAN", "STRUCT<first: STRING, last: STRING>",
     f"CASE WHEN coalesce(is_entity, false) OR raw RLIKE {_r(_TRUST)} OR size(w) = 0 THEN named_struct('first', '', 'last', raw) "
     "ELSE named_struct('first', coalesce(get(w, 1), ''), 'last', get(w, 0)) END"),
    ("split_owner_name", "s STRING, is_entity BOOLEAN", "STRUCT<first: STRING, last: STRING>",
     "split_owner_words(strip_ends(coalesce(s, '')), split_words(substring_index(strip_ends(coalesce(s, '')), '/', 1)), is_entity)"),
    ("mailing_parts", "s STRING", "ARRAY<STRING>", f"transform(split(coalesce(s, ''), ','), t -> {_stripped('t')})"),
    ("mailing_fields", "absentee BOOLEAN, mailing_address STRING, situs_address STRING, situs_city STRING, situs_zip STRING",
     "STRUCT<street: STRING, city: STRING, state: STRING, zip: STRING>",
     "CASE WHEN coalesce(NOT absentee, false) THEN named_struct('street', coalesce(situs_address, ''), 'city', coalesce(situs_city, ''), "
     "'state', 'AZ', 'zip', coalesce(situs_zip, '')) ELSE named_struct("
     + ", ".join(f"'{n}', coalesce(get(mailing_parts(mailing_address), {i}), '')" for i, n in enumerate(("street", "city", "state", "zip"))) + ") END"),
    ("newest_external_id", f"signals {_SIGNAL}, types ARRAY<STRING>", "STRING",
     "coalesce(get(filter(signals, s -> array_contains(types, s.type)), 0).external_id, '')"),
    ("source_urls_joined", f"signals {_SIGNAL}", "STRING",
     "coalesce(array_join(array_distinct(filter(transform(signals, s -> s.source_url), u -> u IS NOT NULL AND u <> '')), '|'), '')"),
    ("owner_initials", "s STRING", "STRING",
     "CASE WHEN size(split_words(s)) = 0 THEN s ELSE array_join(transform(split_words(s), t -> concat(upper(substring(t, 1, 1)), '.')), ' ') END"),
    ("owner_initials_mask", "owner_name STRING, types STRING, is_entity BOOLEAN", "STRING",
     "CASE WHEN arrays_overlap(csv_list(types), array('probate', 'divorce')) AND NOT coalesce(is_entity, false) AND owner_name <> '' "
     "THEN owner_initials(owner_name) ELSE owner_name END"),
    ("score_band", "score INT", "STRING",
     "CASE WHEN score >= 80 THEN 'very_high' WHEN score >= 60 THEN 'high' WHEN score >= 35 THEN 'mid' ELSE 'low' END"),
    ("score_pct", "score INT", "INT", "least(100, cast(floor(score / 160 * 100 + 0.5D) AS INT))"),
    ("is_urgent", "t STRING", "BOOLEAN", f"t IN {_in(K.URGENT_TYPES)}"),
    ("provenance_verb", "t STRING", "STRING", f"coalesce({_look_up(K.PROVENANCE_VERBS, 't')}, 'Recorded')"),
    ("plural_label", "t STRING", "STRING", f"coalesce({_look_up(K.PLURAL_LABELS, 't')}, regexp_replace(t, '_', ' '))"),
    ("short_company_name", "s STRING", "STRING",
     f"strip_ends(regexp_replace(strip_ends(regexp_replace(coalesce(s, ''), {_r(_CUT)}, '')), {_r(_SUFFIX)}, ''))"),
    ("company_subject", "short STRING", "STRING",
     "CASE WHEN short = '' OR length(short) > 28 OR short RLIKE '(?i)s$' THEN 'your next maricopa seller?' "
     "ELSE concat(short, \"'s next maricopa seller?\") END"),
    ("subject_for", "variant STRING, company STRING, n7 BIGINT", "STRING",
     "CASE variant WHEN 'A' THEN 'who filed in maricopa this morning?' WHEN 'B' THEN concat(n7, ' maricopa filings this week') "
     "WHEN 'C' THEN company_subject(short_company_name(company)) WHEN 'D' THEN 'before it hits propstream' END"),
    ("first_name", "s STRING", "STRING", "coalesce(get(split_words(coalesce(s, '')), 0), 'there')"),
    ("is_bot_user_agent", "s STRING", "BOOLEAN", f"strip_ends(coalesce(s, '')) = '' OR s RLIKE {_r('(?i)' + '|'.join(K.BOT_PATTERNS))}"),
    ("is_role_inbox", "email STRING", "BOOLEAN",
     f"instr(coalesce(email, ''), '@') > 0 AND substring_index(lower(substring_index(email, '@', 1)), '+', 1) IN {_in(K.ROLE_LOCAL_PARTS)}"),
    ("site_domain", "url STRING", "STRING",
     r"regexp_replace(lower(try_parse_url(CASE WHEN instr(url, '://') > 0 THEN url ELSE concat('https://', url) END, 'HOST')), r'^www\.', '')"),
    ("is_third_party_domain", "email STRING, url STRING", "BOOLEAN",
     "instr(coalesce(email, ''), '@') > 0 AND coalesce(lower(substring(email, instr(email, '@') + 1)) <> site_domain(nullif(url, '')), false)"),
    ("classify_inbox", "email STRING, url STRING", "STRING",
     "CASE WHEN is_role_inbox(email) THEN 'shared' WHEN is_third_party_domain(email, url) THEN 'third-party' END"),
    ("classify_delivery_error", "code STRING, response_code INT", "STRING",
     f"CASE WHEN NOT coalesce(code IN {_in(K.ABORT_CODES)}, false) AND "
     f"coalesce(response_code BETWEEN 500 AND 599 AND response_code NOT IN {_in(K.ABORT_RESPONSES)}, false) THEN 'bounce' ELSE 'abort' END"),
]

NAMES = [f[0] for f in FUNCTIONS]


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Create all functions in the session, as temporary ones; their names, with the prefix, are returned."""
    own = re.compile(rf"\b({'|'.join(NAMES)})\(")
    for name, parameters, result, body in FUNCTIONS:
        text = own.sub(lambda m: f"{prefix}{m[1]}(", body) if prefix else body
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {result} RETURN {text}")
    return [prefix + n for n in NAMES]


def ensure(spark: SparkSession) -> None:
    """Register the functions unless the session has them."""
    if not spark.catalog.functionExists(NAMES[-1]):
        register(spark)
