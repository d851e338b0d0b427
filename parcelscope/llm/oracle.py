"""The same results as DuckDB SQL, for the operators that SQL can express on whole tables."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LINES = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))"

ORACLE["op8_quality_rules"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w, {_LINES} AS l,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols,
    len(regexp_extract_all(coalesce(text, ''), '[A-Z]')) AS n_upper
  FROM documents),
win AS (
  SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT r, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words
        FROM (SELECT r, unnest(generate_series(i, i + 4)) AS p FROM twice) GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    n_symbols::BIGINT AS n_symbols, n_upper, len(l) AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (r)),
b AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 8 * word_chars THEN 4 ELSE 0 END
    + CASE WHEN 100 * n_upper > 40 * word_chars THEN 8 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 16 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 25 * n_words THEN 32 ELSE 0 END)::BIGINT AS failed_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits
FROM b"""

ORACLE["op2_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT digest, max(page_id) AS first FROM p WHERE octet_length(b) >= 1000 GROUP BY digest)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN g USING (digest)"""

ORACLE["op3_substring_dedup"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
win AS (
  SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
  FROM (SELECT r, doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
again AS (SELECT r, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS first FROM win) WHERE first < doc_id),
gone AS (SELECT r, list(DISTINCT p) AS ps FROM (SELECT r, unnest(generate_series(i, i + 12)) AS p FROM again) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_select(w, list_sort(list_filter(
    generate_series(1, len(w)), lambda x: NOT list_contains(ps, x)))) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (r)"""


def _mixing(sweeps: int = 12, alpha: float = 0.7, rate: float = 0.5) -> str:
    steps, last = [], "c0"
    for i in range(sweeps):
        for m in ("source", "lang", "topic"):
            name = f"c{i + 1}{m[0]}"
            steps.append(f"{name} AS (SELECT * REPLACE (w * want_{m} / sum(w) OVER (PARTITION BY {m}) AS w) FROM {last})")
            last = name
    wants = ", ".join(f"t_{m} / sum(t_{m} / n_{m}) OVER () AS want_{m}" for m in ("source", "lang", "topic"))
    sums = ", ".join(f"pow(sum(tokens) OVER (PARTITION BY {m})::DOUBLE, {alpha}) AS t_{m}, count(*) OVER (PARTITION BY {m}) AS n_{m}"
                     for m in ("source", "lang", "topic"))
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens,
    len(regexp_extract_all(coalesce(text, ''), chr(10))) AS breaks FROM documents),
t AS (SELECT *, CASE WHEN n_tokens < 80 THEN 'notes' WHEN breaks * 12 >= n_tokens THEN 'lists'
    WHEN n_tokens < 1500 THEN 'articles' ELSE 'long' END AS topic FROM d),
cells AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM t GROUP BY ALL HAVING sum(n_tokens) > 0),
s AS (SELECT *, {sums} FROM cells),
c0 AS (SELECT source, lang, topic, tokens, {wants}, tokens / sum(tokens) OVER () AS w FROM s),
{", ".join(steps)},
plan AS (SELECT source, lang, topic, w, {rate} * w * sum(tokens) OVER () / tokens AS e FROM {last})
SELECT doc_id, t.source AS source, t.lang AS lang, t.topic AS topic, n_tokens, round(coalesce(w, 0), 9) AS weight,
  round(coalesce(e, 0), 9) AS expected,
  (floor(coalesce(e, 0)) + CASE WHEN ('0x' || substr(md5('1:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0
    < coalesce(e, 0) - floor(coalesce(e, 0)) THEN 1 ELSE 0 END)::INTEGER AS copies
FROM t LEFT JOIN plan USING (source, lang, topic)"""


ORACLE["op6_mixing"] = _mixing()
