"""Resolution and merges."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T
from ..operators import merge as M
from ..operators import resolve as V
from ..session import shared_folder
from ..streaming import ingest
from .oracle_tables import (
    AS_OF, TODAY, entity_key, is_entity_name, name_norm, norm_address, norm_owner, words_of,
)
from .registry import Tables, query

DECIDED = "source, external_id, apn, confidence, method, n_candidates, candidates"


def _flat(decisions):
    return decisions.withColumn("candidates", F.array_join("candidates", ","))


@query("build_name_index", "SELECT key, apn, nullif(middle, '') AS middle FROM name_index")
def _(t: Tables):
    return t.name_index


@query("resolve_by_name", f"SELECT {DECIDED} FROM name_resolved")
def _(t: Tables):
    return _flat(V.resolve_by_name(t.signals, t.name_index, t.properties))


@query("resolve_by_address", f"SELECT {DECIDED} FROM address_resolved")
def _(t: Tables):
    return _flat(V.resolve_by_address(t.signals, t.properties))


@query("classify_candidates", "SELECT * FROM name_decisions")
def _(t: Tables):
    names = V.name_lookups(t.signals)
    return _flat(V.decide_names(names, t.name_index, t.properties)).drop("method")


_RESOLVED = f"""
  SELECT s.source, s.external_id, coalesce(d.apn, s.apn) AS apn,
    s.apn IS NOT NULL OR d.confidence IS NOT NULL AS resolved,
    coalesce(d.confidence, CASE WHEN s.apn IS NOT NULL THEN 'source' END) AS match_confidence,
    d.method, d.n_candidates
  FROM signals s LEFT JOIN (SELECT {DECIDED} FROM name_resolved
                            UNION ALL SELECT {DECIDED} FROM address_resolved) d
    ON d.source = s.source AND d.external_id = s.external_id"""


@query("resolve_signals", _RESOLVED)
def _(t: Tables):
    resolved, _ = V.resolve_signals(t.signals, t.properties, t.name_index)
    return resolved.select(
        "source", "external_id", "apn", "resolved", "match_confidence",
        F.col("resolution.method").alias("method"), F.col("resolution.count").alias("n_candidates"),
    )


@query("apply_resolution", f"SELECT source, external_id, apn, resolved FROM ({_RESOLVED}) WHERE method = 'address'")
def _(t: Tables):
    done = V.apply_resolution(t.signals, V.resolve_by_address(t.signals, t.properties))
    return done.where(F.col("resolution").isNotNull()).select(
        "source", "external_id", "apn", "resolved"
    )


@query("mark_source_resolved", """
  SELECT source, external_id, apn IS NOT NULL AS resolved,
         CASE WHEN apn IS NOT NULL THEN 'source' END AS match_confidence FROM signals""")
def _(t: Tables):
    return V.mark_source_resolved(t.signals).select(
        "source", "external_id", "resolved", "match_confidence"
    )


@query("resolution_stats", f"""
  SELECT method, count(*) AS attempted, count(apn) AS assigned,
    count_if(confidence = 'exact') AS exact, count_if(confidence = 'probable') AS probable,
    count_if(confidence = 'likely') AS likely, count_if(confidence = 'ambiguous') AS ambiguous,
    count_if(confidence = 'none') AS none
  FROM (SELECT {DECIDED} FROM name_resolved UNION ALL SELECT {DECIDED} FROM address_resolved)
  GROUP BY method""")
def _(t: Tables):
    _, decisions = V.resolve_signals(t.signals, t.properties, t.name_index)
    return V.resolution_stats(decisions)


# --- merges --------------------------------------------------------------------------------------
# The stored snapshot is the first 24 days; the batch re-observes part of it and brings the rest.


def _stored(t: Tables):
    return t.signals.where(F.col("created_at") < "2024-01-25")


def _batch(t: Tables):
    e = F.col("external_id").cast("bigint")
    again = t.signals.where(F.col("created_at") >= "2024-01-10").select(
        *[c for c in M.SIGNAL_KEY], "signal_type", "apn", "source_url", "event_date", "status",
        "owner_name", "situs_address", "raw",
    )
    closed = again.withColumns({
        "status": F.when(e % 4 == 0, "closed").otherwise("open"),
        "apn": F.when(e % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("N"), "external_id")),
        "signal_type": F.lit("other"), "seq": e * 2,
    })
    later = closed.where(e % 5 == 0).withColumns({
        "status": F.lit("reopened"), "seq": F.col("seq") + 1,
    })
    return closed.unionByName(later)


_MERGE_BATCH = """(SELECT source, external_id, event_date,
      CASE WHEN external_id::BIGINT % 5 = 0 THEN 'reopened'
           WHEN external_id::BIGINT % 4 = 0 THEN 'closed' ELSE 'open' END AS status,
      CASE WHEN external_id::BIGINT % 7 <> 0 THEN 'N' || external_id END AS apn
    FROM signals WHERE created_at >= TIMESTAMP '2024-01-10')"""


@query("merge_signals", f"""
  SELECT s.source, s.external_id, coalesce(b.apn, o.apn) AS apn,
    CASE WHEN o.source IS NOT NULL THEN o.signal_type ELSE 'other' END AS signal_type,
    CASE WHEN b.source IS NOT NULL THEN b.status ELSE o.status END AS status,
    s.event_date, coalesce(o.created_at, {AS_OF}) AS created_at,
    CASE WHEN b.source IS NOT NULL THEN {AS_OF} ELSE o.created_at END AS updated_at,
    coalesce(o.observed_date, {TODAY}) AS observed_date
  FROM signals s
  LEFT JOIN (SELECT * FROM signals WHERE created_at < TIMESTAMP '2024-01-25') o
    ON o.source = s.source AND o.external_id = s.external_id
  LEFT JOIN {_MERGE_BATCH} b ON b.source = s.source AND b.external_id = s.external_id""")
def _(t: Tables):
    snapshot, _ = M.merge_signals(_stored(t), _batch(t), t.as_of)
    return snapshot.select(
        "source", "external_id", "apn", "signal_type", "status", "event_date", "created_at",
        "updated_at", "observed_date",
    )


@query("merge_metrics", """
  SELECT source, (count(*) + count_if(external_id::BIGINT % 5 = 0))::BIGINT AS found,
    count_if(created_at >= TIMESTAMP '2024-01-25') AS inserted
  FROM signals WHERE created_at >= TIMESTAMP '2024-01-10' GROUP BY source""")
def _(t: Tables):
    return M.merge_signals(_stored(t), _batch(t), t.as_of)[1]


@query("skip_already_stored", """
  SELECT external_id FROM signals
  WHERE created_at >= TIMESTAMP '2024-01-10' AND NOT (source = 'recorder_nots'
    AND created_at < TIMESTAMP '2024-01-25')""")
def _(t: Tables):
    ids = t.signals.where(F.col("created_at") >= "2024-01-10").select("external_id")
    return M.skip_already_stored(ids, _stored(t), "recorder_nots")


def _parcel_snapshot(t: Tables):
    return M.with_derived_columns(t.properties).withColumn(
        "updated_at", F.lit("2024-01-01 00:00:00").cast("timestamp")
    )


_K = "ltrim(apn, '0')"


@query("merge_properties", f"""
  SELECT apn, CASE WHEN hit THEN 'NEW OWNER ' || apn ELSE owner_name END AS owner_name,
    CASE WHEN hit THEN 'NEW OWNER ' || apn ELSE {norm_owner('owner_name')} END AS owner_name_norm,
    {norm_address("situs_address")} AS situs_norm,
    CASE WHEN hit THEN {AS_OF} ELSE TIMESTAMP '2024-01-01' END AS updated_at
  FROM (SELECT *, apn::BIGINT % 3 = 1 AS hit FROM properties)
  UNION ALL
  SELECT apn || 'X', 'NEW OWNER ' || apn, 'NEW OWNER ' || apn, {norm_address("situs_address")}, {AS_OF}
  FROM properties WHERE apn::BIGINT % 100 = 1""")
def _(t: Tables):
    k = F.col("apn").cast("bigint")
    changed = t.properties.where(k % 3 == 1)
    fresh = t.properties.where(k % 100 == 1)
    rename = lambda d: d.withColumns({
        "owner_name": F.concat(F.lit("NEW OWNER "), F.col("apn")), "seq": F.lit(1)})
    batch = rename(changed).unionByName(
        rename(fresh).withColumn("apn", F.concat("apn", F.lit("X")))
    )
    older = rename(changed).withColumns({"owner_name": F.lit("STALE"), "seq": F.lit(0)})
    merged = M.merge_properties(
        _parcel_snapshot(t), batch.unionByName(older), t.as_of
    )
    return merged.select("apn", "owner_name", "owner_name_norm", "situs_norm", "updated_at")


def _changes(t: Tables, schema: str, merge, batches: list):
    """(snapshot, buckets that the last batch wrote) of a store that takes the batches one by one."""
    store = f"{shared_folder(t.spark)}/table-{uuid.uuid4().hex}"
    write = ingest.merge_changes_into_store(store, schema, ("apn",), merge, buckets=8)
    for number, batch in enumerate(batches):
        write(batch, number)
    versions = ingest.bucket_versions(t.spark, store).values()
    return ingest.read_snapshot(t.spark, store, schema=schema), sum(v == len(batches) - 1 for v in versions)


_PARCEL = "apn string, situs_address string, owner_name string, situs_norm string, owner_name_norm string, owner_name_sorted string, updated_at timestamp"


@query("merge_properties_changes", f"""
  SELECT apn, CASE WHEN hit THEN 'NEW OWNER ' || apn ELSE owner_name END AS owner_name,
    CASE WHEN hit THEN {AS_OF} ELSE TIMESTAMP '2024-01-01' END AS updated_at, 0 AS rewritten
  FROM (SELECT *, apn::BIGINT % 500 = 1 AS hit FROM properties)""")
def _(t: Tables):
    """The roll comes whole each time, with a few new owners; then the same roll once more."""
    parcels = t.properties.select("apn", "situs_address", "owner_name").withColumn("seq", F.lit(1))
    hit = F.col("apn").cast("bigint") % 500 == 1
    renamed = parcels.withColumn("owner_name", F.when(hit, F.concat(F.lit("NEW OWNER "), "apn")).otherwise(F.col("owner_name")))
    first = parcels.withColumn("day", F.lit("2024-01-01 00:00:00"))
    second = renamed.withColumn("day", F.lit(str(t.as_of)))
    merge = lambda old, batch: M.merge_properties(old, batch.drop("day"), batch.first()["day"])
    third = renamed.withColumn("day", F.lit("2024-02-10 00:00:00"))
    rows, rewritten = _changes(t, _PARCEL, merge, [first, second, third])
    return rows.select("apn", "owner_name", "updated_at", F.lit(rewritten).alias("rewritten"))


@query("merge_scores_changes", f"""
  SELECT apn, score, CASE WHEN apn::BIGINT % 7 = 0 THEN {AS_OF} ELSE TIMESTAMP '2024-01-01' END AS updated_at, 0 AS rewritten FROM scores""")
def _(t: Tables):
    scored = t.scores.select("apn", "score")
    old = scored.withColumn("score", F.when(F.col("apn").cast("bigint") % 7 == 0, F.col("score") + 1).otherwise(F.col("score")))
    days = ("2024-01-01 00:00:00", str(t.as_of), "2024-02-10 00:00:00")
    batches = [b.withColumn("day", F.lit(d)) for b, d in zip((old, scored, scored), days)]
    merge = lambda stored, batch: M.merge_scores(stored, batch.drop("day"), batch.first()["day"])
    rows, rewritten = _changes(t, "apn string, score int, updated_at timestamp", merge, batches)
    return rows.select("apn", "score", "updated_at", F.lit(rewritten).alias("rewritten"))


@query("merge_scores", f"""
  SELECT apn, CASE WHEN s.apn IS NOT NULL THEN s.score ELSE 1 END AS score,
    CASE WHEN s.apn IS NOT NULL THEN {AS_OF} ELSE TIMESTAMP '2024-01-01' END AS updated_at
  FROM (SELECT apn FROM properties UNION SELECT apn FROM scores) FULL JOIN scores s USING (apn)""")
def _(t: Tables):
    old = t.properties.select(
        "apn", F.lit(1).alias("score"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("updated_at")
    )
    return M.merge_scores(old, t.scores, t.as_of)


@query("recompute_absentee", """
  SELECT apn, absentee AS old_absentee, apn::BIGINT % 4 <> 0 AS new_absentee FROM properties
  WHERE absentee IS DISTINCT FROM (apn::BIGINT % 4 <> 0)""")
def _(t: Tables):
    parcels = t.properties.select("apn", (F.col("apn").cast("bigint") % 4 != 0).alias("absentee"))
    return M.recompute_absentee(t.properties, parcels)


@query("absentee_delta", """
  SELECT count_if(absentee) AS n_before, count_if(apn::BIGINT % 4 <> 0) AS n_after,
         count_if(apn::BIGINT % 4 <> 0) - count_if(absentee) AS delta FROM properties""")
def _(t: Tables):
    after = t.properties.select((F.col("apn").cast("bigint") % 4 != 0).alias("absentee"))
    return M.absentee_delta(t.properties, after)


@query("backfill_situs_norm", f"""
  SELECT apn, CASE WHEN apn::BIGINT % 2 = 0 THEN 'KEPT' ELSE {norm_address('situs_address')} END AS situs_norm
  FROM properties""")
def _(t: Tables):
    kept = F.when(F.col("apn").cast("bigint") % 2 == 0, "KEPT")
    return M.backfill_situs_norm(t.properties.withColumn("situs_norm", kept)).select(
        "apn", "situs_norm"
    )


@query("backfill_owner_sorted", f"""
  SELECT apn, CASE WHEN apn::BIGINT % 2 = 0 THEN 'KEPT'
    ELSE array_to_string(list_sort({words_of(norm_owner('owner_name'))}), ' ') END AS owner_name_sorted
  FROM properties""")
def _(t: Tables):
    kept = F.when(F.col("apn").cast("bigint") % 2 == 0, "KEPT")
    return M.backfill_owner_sorted(t.properties.withColumn("owner_name_sorted", kept)).select(
        "apn", "owner_name_sorted"
    )


@query("lead_actions_toggle", f"""
  WITH acts AS (SELECT lpad(c_custkey::VARCHAR, 10, '0') AS apn,
      CASE WHEN c_custkey % 5 = 0 THEN 'saved' ELSE 'hidden' END AS action FROM customer
      WHERE c_custkey % 5 < 2),
  log AS (SELECT lpad((CASE WHEN event_id % 6 = 1 THEN 7 ELSE user_id * 10 + event_id % 10 END)::VARCHAR, 10, '0') AS apn,
      CASE WHEN event_id % 3 = 0 THEN 'hidden' ELSE 'saved' END AS action,
      arg_max(event_id % 4 <> 0, event_id) AS flag
      FROM events WHERE event_type = 'click' GROUP BY 1, 2)
  SELECT apn, action FROM acts WHERE NOT EXISTS (
    SELECT 1 FROM log l WHERE l.apn = acts.apn AND l.action = acts.action)
  UNION SELECT apn, action FROM log WHERE flag""")
def _(t: Tables):
    return M.lead_actions_toggle(t.lead_actions, t.action_log)


# --- name functions over whole tables -----------------------------------------------------------

_PERSONS = """
  SELECT apn, string_agg(key || coalesce('/' || nullif(mid, ''), ''), ';' ORDER BY pos) AS persons FROM (
    SELECT apn, pos, CASE WHEN len(full_words) >= 2 THEN full_words[1] ELSE prev END || '|' ||
        CASE WHEN len(full_words) >= 2 THEN full_words[2] ELSE full_words[1] END AS key,
      coalesce(CASE WHEN len(full_words) >= 2 THEN full_words[3] END, initials[1], '') AS mid
    FROM (SELECT *, coalesce(
            last_value(CASE WHEN len(full_words) >= 2 THEN full_words[1] END IGNORE NULLS) OVER w,
            first_value(CASE WHEN len(full_words) = 1 THEN full_words[1] END IGNORE NULLS) OVER w) AS prev
          FROM index_parts WINDOW w AS (PARTITION BY apn ORDER BY pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    WHERE len(full_words) >= 2 OR (len(full_words) = 1 AND prev IS NOT NULL))
  GROUP BY apn"""


@query("persons_from_owner", _PERSONS)
def _(t: Tables):
    text = F.transform(
        N.persons_from_owner("owner_name"),
        lambda p: F.concat(
            p["last"], F.lit("|"), p["first"],
            F.coalesce(F.concat(F.lit("/"), p["middle"]), F.lit("")),
        ),
    )
    rows = t.properties.select("apn", F.array_join(text, ";").alias("persons"))
    return rows.where(F.col("persons") != "")


@query("property_keys", """
  SELECT apn, string_agg(key, ';' ORDER BY key) AS keys FROM name_index WHERE key[1] <> '=' GROUP BY apn""")
def _(t: Tables):
    keys = F.array_sort(N.property_keys("owner_name"))
    rows = t.properties.select("apn", F.array_join(keys, ";").alias("keys"))
    return rows.where(F.col("keys") != "")


@query("signal_keys", """
  SELECT owner_name, string_agg(key, ';' ORDER BY ord) AS keys FROM name_keys GROUP BY owner_name""")
def _(t: Tables):
    names = V.name_lookups(t.signals)
    return names.where(F.size("keys") > 0).select("owner_name", F.array_join("keys", ";").alias("keys"))


@query("signal_middles", """
  SELECT owner_name, string_agg(m, ';' ORDER BY m) AS mids FROM name_mids GROUP BY owner_name""")
def _(t: Tables):
    names = V.name_lookups(t.signals)
    return names.where(F.size("mids") > 0).select(
        "owner_name", F.array_join(F.array_sort("mids"), ";").alias("mids")
    )


_NORM = name_norm("owner_name")


@query("entity_key", f"""
  SELECT apn, {_NORM} AS name_norm, {is_entity_name(_NORM)} AS is_entity, {entity_key(_NORM)} AS entity_key
  FROM properties""")
def _(t: Tables):
    return t.properties.select(
        "apn", N.name_normalize("owner_name").alias("name_norm"),
        N.is_entity_name("owner_name").alias("is_entity"), N.entity_key("owner_name").alias("entity_key"),
    )


@query("person_tokens", f"""
  SELECT apn, pos, array_to_string(full_words, ' ') AS full_words, array_to_string(initials, ' ') AS initials
  FROM index_parts""")
def _(t: Tables):
    pieces = F.filter(F.split(N.name_normalize("owner_name"), r"\s*[/&]\s*"), lambda p: p != "")
    rows = t.properties.where(
        F.col("owner_name").isNotNull() & ~N.is_entity_name("owner_name")
    ).select("apn", F.posexplode(F.transform(pieces, N.person_tokens)).alias("pos", "toks"))
    part = lambda cond: F.array_join(F.filter("toks", cond), " ")
    return rows.select(
        "apn", (F.col("pos") + 1).cast("bigint").alias("pos"),
        part(lambda x: F.length(x) > 1).alias("full_words"),
        part(lambda x: F.length(x) == 1).alias("initials"),
    )


@query("sorted_name_key", f"""
  SELECT apn, array_to_string(list_sort({words_of(norm_owner('owner_name'))}), ' ') AS name_key FROM properties""")
def _(t: Tables):
    return t.properties.select("apn", T.sorted_name_key("owner_name").alias("name_key"))
