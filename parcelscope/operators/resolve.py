"""Signals to parcels: by parcel number, by owner-name key, by street address.

Name resolution never pairs the signals and the parcels of a hot key. Parcels are folded per key and
middle initial, and per key map (all keys of a parcel with their initials). A name adds up the folds of
its keys, so a key that a third of all parcels have costs a name as many rows as the key has initials.
Parcels with two of a name's keys (a couple's, say) are then counted too often; they are found by the
pair of keys, and their folds are taken off again. Up to 20 candidates are shown; no decision depends
on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import names as N
from ..functions import text as T
from ..session import cut_lineage
from .topk import first_rows

CANDIDATES_SHOWN = 20
DECISION = "apn string, confidence string, method string, n_candidates bigint, candidates array<string>"


def build_name_index(properties: DataFrame) -> DataFrame:
    """(key, apn, middle): one row per key of a parcel; its first person with the key wins.

    Parcels are dealt out before their names are read: the table is small on disk, so its few splits would
    be few tasks. Grouping by key and parcel needs no further exchange."""
    named = properties.where(F.col("owner_name").isNotNull()).select(
        "apn", "owner_name"
    ).repartition("apn").select("apn", N.name_normalize("owner_name").alias("norm"))
    persons = F.transform(
        N.persons_from_owner("norm", normalized=True),
        lambda p: F.struct(
            F.concat(p["last"], F.lit("|"), p["first"]).alias("key"), p["middle"].alias("middle")
        ),
    )
    entity = F.array(
        F.struct(
            N.entity_key("norm", normalized=True).alias("key"),
            F.lit(None).cast("string").alias("middle"),
        )
    )
    entries = F.when(N.is_entity_name("norm", normalized=True), entity).otherwise(persons)
    exploded = named.select("apn", F.posexplode(entries).alias("pos", "e")).select(
        F.col("e.key").alias("key"), "apn", F.col("e.middle").alias("middle"), "pos"
    )
    # min_by skips NULL ordering only, so a first person without a middle name keeps NULL.
    return (
        exploded.where(F.col("key").isNotNull())
        .groupBy("key", "apn")
        .agg(F.min_by("middle", "pos").alias("middle"))
    )


def _bounded_sample(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The smallest CANDIDATES_SHOWN values of every group as a sorted array."""
    head = first_rows(df.select(*keys, value), keys, [F.col(value)], CANDIDATES_SHOWN)
    return head.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias(name))


def _initial(c) -> Column:
    return F.nullif(F.substring(c, 1, 1), F.lit(""))


def _folded() -> list[Column]:
    """Aggregates of parcels: how many, how many owner-occupied, and the first of each."""
    home = F.when(F.col("home"), F.col("apn"))
    return [
        F.count("*").alias("c"), F.count(home).alias("c_home"),
        F.min("apn").alias("first"), F.min(home).alias("first_home"),
    ]


def _code() -> Column:
    return F.xxhash64("apn").cast("decimal(20,0)")


def _key_maps(index: DataFrame) -> DataFrame:
    """Parcels folded by their key map: `keys` is an array of (key, initial)."""
    per_parcel = index.groupBy("apn", "home").agg(
        F.sort_array(F.collect_list(F.struct("key", "initial"))).alias("keys")
    )
    return per_parcel.withColumn("map", F.to_json("keys")).withColumn("code", _code())


def _tagged_index(index: DataFrame, properties: DataFrame) -> DataFrame:
    home = F.coalesce(~F.col("absentee"), F.lit(False))
    parcels = properties.select("apn", home.alias("home"))
    return index.join(parcels, "apn").select("key", "apn", _initial("middle").alias("initial"), "home")


def name_lookups(signals: DataFrame, sources=K.NAME_SOURCES) -> DataFrame:
    """Distinct owner names that still need a parcel, with their keys and initials."""
    open_names = signals.where(
        F.col("apn").isNull() & F.col("owner_name").isNotNull() & F.col("source").isin(list(sources))
    ).select("owner_name").distinct().withColumn("norm", N.name_normalize("owner_name"))
    middles = F.transform(N.signal_middles("norm", normalized=True), _initial)
    return open_names.select(
        "owner_name", N.lookup_keys("norm", normalized=True).alias("keys"),
        F.array_distinct(middles).alias("mids"),
    )


def decide_names(names: DataFrame, index: DataFrame, properties: DataFrame) -> DataFrame:
    """One decision per distinct owner name: see DECISION for the columns.

    Names with the same keys and initials are one form and decided once. The names, the forms and the
    tagged index are read several times below, so each is written once. (Were the names not, the join on
    the form would take "has a form" down to the signals and read each signal's name for it again.)
    """
    names = cut_lineage(names.withColumn("form", F.to_json(F.struct("keys", "mids"))), "names")
    forms = cut_lineage(names.select("form", "keys", "mids").distinct(), "forms")
    idx = cut_lineage(_tagged_index(index, properties).withColumn("code", _code()), "name-index")
    maps = cut_lineage(_key_maps(idx), "key-maps")
    totals = cut_lineage(_totals(forms, idx, maps), "totals")
    both = totals.join(_only_agreeing(totals, forms, idx), "form", "left").join(_shown(forms, idx, maps), "form", "left")
    return names.select("owner_name", "form").join(_classify(both), "form").drop("form")


def _agrees(initial: Column) -> Column:
    return F.coalesce(F.array_contains("mids", initial), F.lit(False))


def _sums(c: str, c_home: str, s: str, s_home: str, times: Column, ok: Column) -> list[Column]:
    """Sums of a fold: how many parcels and homes, and of those that agree also the sum of their codes."""
    return [F.sum(F.col(c) * times).alias("n"), F.sum(F.col(c_home) * times).alias("n_home"),
            F.sum(F.col(c) * ok).alias("m"), F.sum(F.col(c_home) * ok).alias("m_home"),
            F.sum(F.col(s) * ok).alias("s"), F.sum(F.col(s_home) * ok).alias("s_home")]


_COUNTS = ("n", "n_home", "m", "m_home", "s", "s_home")


def _totals(forms: DataFrame, idx: DataFrame, maps: DataFrame) -> DataFrame:
    """Parcels that a form reaches, by inclusion and exclusion: the folds of its keys are added up, and
    what is counted too often is taken off, for the key maps that hold two of its keys or more."""
    per_key = idx.groupBy("key", "initial").agg(*_folded(), *_codes())
    looked = forms.select("form", "mids", F.explode("keys").alias("key")).join(per_key, "key")
    one, ok = F.lit(1), _agrees(F.col("initial")).cast("int")
    added = looked.groupBy("form").agg(*_sums("c", "c_home", "sum_code", "sum_home_code", one, ok),
                                       F.min("first").alias("first"), F.min("first_home").alias("first_home"))
    per_map = maps.where(F.size("keys") > 1).groupBy("map").agg(*_folded(), *_codes(), F.first("keys").alias("held"))
    met = _meeting(forms, per_map).withColumn("hits", _hits("keys", "held"))
    agreeing = F.size(F.filter("hits", lambda h: _agrees(h["initial"])))
    too_many = agreeing - _last_agrees("hits").cast("int")
    excess = met.groupBy("form").agg(*_sums("c", "c_home", "sum_code", "sum_home_code", F.size("hits") - 1, too_many))
    excess = excess.toDF("form", *[f"{c}_off" for c in _COUNTS])
    net = forms.select("form").join(added, "form", "left").join(excess, "form", "left")
    zero = F.lit(0)
    return net.select("form", "first", "first_home", *[
        (F.coalesce(F.col(c), zero) - F.coalesce(F.col(f"{c}_off"), zero)).alias(c) for c in _COUNTS])


def _codes() -> list[Column]:
    """Sums of the parcels' codes: a sum over one parcel tells which it is."""
    home = F.when(F.col("home"), F.col("code")).otherwise(F.lit(0).cast("decimal(20,0)"))
    return [F.sum("code").alias("sum_code"), F.sum(home).alias("sum_home_code")]


def _hits(keys: str, held: str) -> Column:
    """Entries of a parcel whose key the form has, in the form's order of keys."""
    found = F.filter(held, lambda e: F.array_contains(keys, e["key"]))
    placed = F.transform(found, lambda e: F.struct(F.array_position(keys, e["key"]).alias("pos"), e["initial"].alias("initial")))
    return F.array_sort(placed)


def _last_agrees(hits: str) -> Column:
    """A parcel's last key in the form's order decides whether it agrees on the initial."""
    return _agrees(F.element_at(hits, -1)["initial"])


def _meeting(forms: DataFrame, per_map: DataFrame) -> DataFrame:
    """Forms beside the key maps that hold two of their keys, found by the pair and not by one hot key."""
    pairs = per_map.select("map", F.explode("held.key").alias("a"), "held").select(
        "map", "a", F.explode("held.key").alias("b")).where("a < b")
    several = forms.where(F.size("keys") > 1).select("form", F.explode("keys").alias("a"), "keys").select(
        "form", "a", F.explode("keys").alias("b")).where("a < b")
    met = several.join(pairs, ["a", "b"]).select("form", "map").distinct()
    return met.join(per_map, "map").join(forms, "form")


def _only_agreeing(totals: DataFrame, forms: DataFrame, idx: DataFrame) -> DataFrame:
    """(form, m_first, m_first_home) where one parcel, or one home, agrees: looked up by key and code."""
    one = F.when(F.col("m") == 1, F.struct(F.lit("m_first").alias("what"), F.col("s").alias("code")))
    home = F.when(F.col("m_home") == 1, F.struct(F.lit("m_first_home").alias("what"), F.col("s_home").alias("code")))
    asked = totals.select("form", F.explode(F.array_compact(F.array(one, home))).alias("q")).join(forms, "form").select(
        "form", "q.what", F.col("q.code").cast("decimal(20,0)").alias("code"), F.explode("keys").alias("key"))
    found = asked.join(idx.select("key", "code", "apn"), ["key", "code"])
    pick = lambda what: F.min(F.when(F.col("what") == what, F.col("apn"))).alias(what)
    return found.groupBy("form").agg(pick("m_first"), pick("m_first_home"))


def _shown(forms: DataFrame, idx: DataFrame, maps: DataFrame, spare: int = CANDIDATES_SHOWN) -> DataFrame:
    """(form, apns, m_apns): the first few of all candidates, and of those that agree.

    A key and initial hands out its first few parcels, and `spare` more, as some of them may be decided by
    another key of the form. Forms for which that was not enough look at all parcels of their keys."""
    n = CANDIDATES_SHOWN + spare
    few = first_rows(idx.select("key", "initial", "apn"), ["key", "initial"], [F.col("apn")], n)
    few = few.select("key", "initial", "apn").join(maps.select("apn", F.col("keys").alias("held")), "apn")

    def beside(some: DataFrame, parcels: DataFrame) -> DataFrame:
        looked = some.select("form", "mids", "keys", F.explode("keys").alias("key"))
        rows = looked.join(parcels, "key").withColumn("hits", _hits("keys", "held"))
        return rows.select("form", "key", "initial", "apn", _agrees(F.col("initial")).alias("key_ok"), _last_agrees("hits").alias("ok"))

    rows = cut_lineage(beside(forms, few), "shown")
    short = rows.where("key_ok").groupBy("form", "key", "initial").agg(F.count("*").alias("c"), F.count_if("ok").alias("left"))
    short = cut_lineage(short.where((F.col("c") >= n) & (F.col("left") < CANDIDATES_SHOWN)).select("form").distinct(), "short")
    if not short.isEmpty():
        every = idx.select("key", "initial", "apn").join(maps.select("apn", F.col("keys").alias("held")), "apn")
        rows = rows.join(short, "form", "left_anti").unionByName(beside(forms.join(short, "form", "left_semi"), every))
    rows = rows.select("form", "apn", "ok").distinct()
    return _bounded_sample(rows, ["form"], "apn", "apns").join(
        _bounded_sample(rows.where("ok"), ["form"], "apn", "m_apns"), "form", "left")


def _classify(c: DataFrame) -> DataFrame:
    """Totals to a decision.

    One candidate is taken. Of several, those that agree on a middle initial are preferred; then
    the only owner-occupied one; otherwise the name stays ambiguous.
    """
    n, m = F.col("n"), F.col("m")
    narrowed = (n > 1) & (m > 1)
    homes = F.when(narrowed, F.col("m_home")).otherwise(F.col("n_home"))
    apn = (
        F.when(n == 1, F.col("first"))
        .when((n > 1) & (m == 1), F.col("m_first"))
        .when((n > 1) & (homes == 1), F.when(narrowed, F.col("m_first_home")).otherwise(F.col("first_home")))
    )
    confidence = (
        F.when(n == 0, "none")
        .when((n == 1) & (m == 1), "exact")
        .when((n == 1) | (m == 1), "probable")
        .when(homes == 1, "likely")
        .otherwise("ambiguous")
    )
    shown = F.when(narrowed, F.col("m_apns")).otherwise(F.col("apns"))
    return c.select(
        "form", apn.alias("apn"), confidence.alias("confidence"),
        F.lit("keys").alias("method"),
        F.when(narrowed, m).otherwise(n).alias("n_candidates"),
        F.coalesce(shown, F.array().cast("array<string>")).alias("candidates"),
    )


def resolve_by_name(
    signals: DataFrame, index: DataFrame, properties: DataFrame, sources=K.NAME_SOURCES
) -> DataFrame:
    """Decisions (source, external_id + DECISION) for signals that have a name but no parcel."""
    decisions = decide_names(name_lookups(signals, sources), index, properties)
    todo = signals.where(
        F.col("apn").isNull() & F.col("owner_name").isNotNull() & F.col("source").isin(list(sources))
    ).select("source", "external_id", "owner_name")
    return todo.join(decisions, "owner_name").drop("owner_name")


def classify_candidates(groups: DataFrame, when_unique: str = "exact") -> DataFrame:
    """Decision for groups that already hold a candidate count and a bounded sample."""
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    return groups.withColumns(
        {
            "apn": F.when(n == 1, F.get("apns", F.lit(0))),
            "confidence": F.when(n == 0, "none").when(n == 1, when_unique).otherwise("ambiguous"),
            "n_candidates": n,
            "candidates": F.coalesce("apns", F.array().cast("array<string>")),
        }
    )


def resolve_by_address(
    signals: DataFrame, properties: DataFrame, sources=K.ADDRESS_SOURCES
) -> DataFrame:
    """Decisions by equal street line. Parcels are folded per street line before the join."""
    key = T.street_only("situs_address")
    todo = signals.where(
        ~F.coalesce("resolved", F.lit(False)) & F.col("apn").isNull()
        & F.col("situs_address").isNotNull() & F.col("source").isin(list(sources))
    ).select("source", "external_id", key.alias("street"))
    known = F.coalesce(F.length("street") >= 4, F.lit(False))
    parcels = properties.select(
        T.normalize_address("situs_address").alias("street"), "apn"
    ).where(F.length("street") >= 4)
    folded = parcels.groupBy("street").agg(F.count("*").alias("n")).join(
        _bounded_sample(parcels, ["street"], "apn", "apns"), "street"
    )
    # Streets too short to look up are left out of the join, which would send them to one task.
    met = todo.where(known).join(folded, "street", "left")
    blank = todo.where(~known).withColumns(
        {"n": F.lit(0).cast("bigint"), "apns": F.array().cast("array<string>")}
    )
    matched = classify_candidates(met.unionByName(blank))
    return matched.select(
        "source", "external_id", "apn", "confidence", F.lit("address").alias("method"),
        "n_candidates", "candidates",
    )


def mark_source_resolved(signals: DataFrame) -> DataFrame:
    """Signals that came with a parcel number are resolved by their source."""
    newly = F.col("apn").isNotNull() & ~F.coalesce("resolved", F.lit(False))
    return signals.withColumns(
        {
            "match_confidence": F.when(newly, "source").otherwise(F.col("match_confidence")),
            "resolved": newly | F.coalesce("resolved", F.lit(False)),
        }
    )


def apply_resolution(signals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Write decisions into the signals; a decision without a parcel leaves apn alone."""
    made = decisions.select(
        "source", "external_id", F.col("apn").alias("d_apn"), F.col("confidence").alias("d_conf"),
        F.struct(
            F.col("method"), F.col("n_candidates").alias("count"), F.col("candidates")
        ).alias("d_res"),
    )
    hit = F.col("d_conf").isNotNull()
    return (
        signals.join(made, ["source", "external_id"], "left")
        .withColumns(
            {
                "apn": F.coalesce("d_apn", "apn"),
                "resolved": hit | F.coalesce("resolved", F.lit(False)),
                "match_confidence": F.coalesce("d_conf", "match_confidence"),
                "resolution": F.when(hit, F.col("d_res")).otherwise(F.col("resolution")),
            }
        )
        .select(*signals.columns)
    )


def resolve_signals(signals: DataFrame, properties: DataFrame, index: DataFrame | None = None):
    """(resolved signals, decisions). The passes look at different sources, so one write does it."""
    index = build_name_index(properties) if index is None else index
    marked = mark_source_resolved(signals)
    decisions = resolve_by_name(marked, index, properties).unionByName(
        resolve_by_address(marked, properties)
    )
    return apply_resolution(marked, decisions), decisions


def resolution_stats(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("method").agg(
        F.count("*").alias("attempted"),
        F.count("apn").alias("assigned"),
        *[
            F.count_if(F.col("confidence") == c).alias(c)
            for c in ("exact", "probable", "likely", "ambiguous", "none")
        ],
    )
