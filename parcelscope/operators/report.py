"""What arrived in a window, one row per parcel (or unmatched owner), enriched and ranked."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import dates as D
from ..functions import display as X
from ..functions import text as T
from .topk import first_rows

def _newest_first() -> list[Column]:
    return [
        F.col("event_date").desc_nulls_last(), F.col("created_at").desc(), F.col("source"),
        F.col("external_id"),
    ]


def arrival_window(signals: DataFrame, as_of, hours: int) -> DataFrame:
    now = D.as_of_col(as_of)
    return signals.where(F.col("created_at") > now - F.make_dt_interval(hours=F.lit(hours)))


def phoenix_cutoff(as_of, days: int) -> Column:
    return F.date_sub(D.phoenix_date(D.as_of_col(as_of)), max(0, int(days)))


def filed_window_days(signals: DataFrame, as_of, days: int | None) -> DataFrame:
    """Filed within N Phoenix calendar days; None keeps every row."""
    if days is None:
        return signals
    return signals.where(F.col("event_date") >= phoenix_cutoff(as_of, days))


def filed_window_hours(signals: DataFrame, as_of, hours: int | None) -> DataFrame:
    """Filed on or after the UTC day N hours ago; None keeps every row."""
    if not hours:
        return signals
    since = F.to_date(D.as_of_col(as_of) - F.make_dt_interval(hours=F.lit(int(hours))))
    return signals.where(F.col("event_date") >= since)


def resolve_window_option(key: str | None) -> int:
    """Hours of a named arrival window; an unknown name is the default."""
    return K.WINDOW_HOURS.get(key, K.WINDOW_HOURS[K.DEFAULT_WINDOW])


def resolve_filed_option(key: str | None) -> int | None:
    """Days of a named filed window; an unknown name is the default, 'any' is None."""
    return K.FILED_DAYS[key if key in K.FILED_DAYS else K.DEFAULT_FILED]


def dedupe_resolved(fresh: DataFrame) -> DataFrame:
    """The newest signal of every parcel."""
    return first_rows(fresh.where(F.col("apn").isNotNull()), ["apn"], _newest_first())


def dedupe_resolved_in_buckets(fresh: DataFrame) -> DataFrame:
    """As dedupe_resolved, for tables bucketed by parcel, where one task has a busy parcel's rows whole.

    Day and time of arrival as one number are folded by hash; rows below their parcel's newest fall away as they
    are read, and only ties on both are sorted. A bucket's parcels (one number each) are held in memory. The
    condition is no equality, which would become a second key and call for an exchange.
    """
    day = F.coalesce(F.unix_date("event_date"), F.lit(-(2**31))).cast("decimal(38,0)")
    time = F.coalesce(F.unix_micros("created_at"), F.lit(-(2**63))).cast("decimal(38,0)")
    known = fresh.where(F.col("apn").isNotNull()).withColumn("__at", day * F.lit(Decimal(10**20)) + time)
    newest = known.groupBy("apn").agg(F.max("__at").alias("__newest")).hint("shuffle_hash")
    kept = known.join(newest, "apn").where(F.col("__at") >= F.col("__newest"))
    return first_rows(kept, ["apn"], _newest_first()).select(*fresh.columns)


def dedupe_unresolved(fresh: DataFrame) -> DataFrame:
    """The newest signal of every (owner, type) without a parcel; missing owners form one group."""
    return first_rows(
        fresh.where(F.col("apn").isNull()), ["owner_name", "signal_type"], _newest_first()
    )


def combine_resolved_unresolved(resolved: DataFrame, unresolved: DataFrame) -> DataFrame:
    return resolved.unionByName(unresolved)


def distinct_apns(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("apn").isNotNull()).select("apn").distinct()


def apn_semi_reduce(signals: DataFrame, apns: DataFrame) -> DataFrame:
    return signals.join(apns, "apn", "left_semi")


def apn_stats(signals: DataFrame) -> DataFrame:
    """Stacked types, their list and the newest trustee-sale date per parcel.

    Folding by (apn, type) first keeps a busy parcel from reaching one task unaggregated.
    """
    per_type = (
        signals.where(F.col("apn").isNotNull())
        .groupBy("apn", "signal_type")
        .agg(F.max("event_date").alias("newest"))
    )
    trustee = F.when(F.col("signal_type") == "trustee_sale", F.col("newest"))
    return per_type.groupBy("apn").agg(
        F.count("signal_type").cast("int").alias("stacked_types"),
        F.array_join(F.array_sort(F.collect_list("signal_type")), ",").alias("signal_types"),
        F.max(trustee).alias("trustee_date"),
    )


def latest_signal_per_type(signals: DataFrame) -> DataFrame:
    return first_rows(
        signals.where(F.col("apn").isNotNull()), ["apn", "signal_type"], _newest_first()
    )


def _provenance_entry() -> Column:
    return F.struct(
        F.col("signal_type").alias("type"), F.col("source"), F.col("external_id"),
        F.col("source_url"), F.col("event_date"), F.col("created_at").alias("first_seen"),
    )


def provenance_top6(latest: DataFrame, n: int = 6) -> DataFrame:
    """Per parcel its newest signals (one per type, at most n) as an array, newest first."""
    ranked = first_rows(latest, ["apn"], _newest_first(), n, rank="rn")
    packed = F.sort_array(F.collect_list(F.struct("rn", _provenance_entry().alias("s"))))
    return ranked.groupBy("apn").agg(F.transform(packed, lambda e: e["s"]).alias("signals"))


REPORT_COLUMNS = [
    "apn", "signal_type", "source", "event_date", "owner_name", "situs_address", "situs_city",
    "situs_zip", "score", "is_hot", "stacked_types", "signal_types", "mailing_address",
    "absentee", "is_entity", "assessed_value", "last_sale_price", "last_sale_date",
    "years_owned", "est_auction_date",
]


def report_enrich(
    resolved: DataFrame, unresolved: DataFrame, signals: DataFrame, properties: DataFrame,
    scores: DataFrame, as_of, provenance: bool = False,
) -> DataFrame:
    """Report rows with parcel, score, stacking and entity columns.

    Only rows with a parcel take part in the joins on apn; rows without one get their columns from
    themselves, so no NULL key is ever shuffled. Signals are folded per parcel and type before they meet the
    rows, so a busy parcel's history is neither sorted nor joined.
    """
    seen = [
        "apn", "signal_type", "source", "external_id", "source_url", "event_date", "owner_name",
        "created_at",
    ]
    resolved, unresolved = resolved.select(*seen), unresolved.select(*seen)
    parcels = properties.select(
        "apn", F.col("owner_name").alias("p_owner"), "situs_address", "situs_city", "situs_zip",
        "mailing_address", "absentee", "assessed_value", "last_sale_price", "last_sale_date",
    )
    marks = scores.select("apn", "score", F.col("hot").alias("is_hot"))
    with_parcel = (
        resolved.join(apn_stats(signals), "apn", "left")
        .join(parcels, "apn", "left")
        .join(marks, "apn", "left")
        .withColumn("stacked_types", F.coalesce("stacked_types", F.lit(0)))
    )
    if provenance:
        ours = apn_semi_reduce(signals, resolved.select("apn"))
        entries = provenance_top6(latest_signal_per_type(ours))
        with_parcel = with_parcel.join(entries, "apn", "left")
    trustee = F.when(F.col("signal_type") == "trustee_sale", F.col("event_date"))
    alone = unresolved.withColumns(
        {
            "stacked_types": F.lit(0),
            "signal_types": F.col("signal_type"),
            "trustee_date": trustee,
            **({"signals": F.array(_provenance_entry())} if provenance else {}),
        }
    )
    rows = with_parcel.unionByName(alone, allowMissingColumns=True)
    owner = F.coalesce("p_owner", "owner_name")
    return rows.withColumn("owner_name", owner).withColumns(
        {
            "is_entity": T.is_entity_owner("owner_name"),
            "years_owned": D.years_owned("last_sale_date", as_of),
            "est_auction_date": D.est_auction_date("trustee_date"),
        }
    )


def homeowners_only(enriched: DataFrame, on: bool = True) -> DataFrame:
    return enriched.where(F.col("owner_name").isNotNull() & ~F.col("is_entity")) if on else enriched


def _report_order(seen: str = "created_at") -> list[Column]:
    return [
        F.col("score").desc_nulls_last(), F.col(seen).desc(),
        F.col("apn").asc_nulls_last(), F.col("owner_name").asc_nulls_last(), F.col("signal_type"),
    ]


def report_rows(enriched: DataFrame, limit: int) -> DataFrame:
    """The best rows; a top-k, so nothing but k rows per task is kept."""
    return enriched.orderBy(*_report_order()).limit(limit)


def _enriched(signals, properties, scores, as_of, hours, filed, provenance=False) -> DataFrame:
    fresh = filed(arrival_window(signals, as_of, hours))
    return report_enrich(
        dedupe_resolved(fresh), dedupe_unresolved(fresh), signals, properties, scores, as_of,
        provenance,
    )


def report_all(
    signals: DataFrame, properties: DataFrame, scores: DataFrame, as_of, hours: int = 24,
    filed_days: int | None = None,
) -> DataFrame:
    """All homeowner rows of the daily report, without its order and limit."""
    return homeowners_only(_enriched(
        signals, properties, scores, as_of, hours, lambda s: filed_window_days(s, as_of, filed_days)))


def daily_report(
    signals: DataFrame, properties: DataFrame, scores: DataFrame, as_of, hours: int = 24,
    limit: int = 50, homeowners: bool = True, filed_days: int | None = K.FILED_WINDOW_DAYS,
) -> DataFrame:
    rows = _enriched(
        signals, properties, scores, as_of, hours,
        lambda s: filed_window_days(s, as_of, filed_days),
    )
    return report_rows(homeowners_only(rows, homeowners), limit).select(
        *REPORT_COLUMNS, "created_at"
    )


def web_report(
    signals: DataFrame, properties: DataFrame, scores: DataFrame, as_of, hours: int = 24,
    limit: int = 50, homeowners: bool = True, filed_hours: int | None = None,
) -> DataFrame:
    """As the daily report, with the UTC filed window and each row's provenance array."""
    rows = _enriched(
        signals, properties, scores, as_of, hours,
        lambda s: filed_window_hours(s, as_of, filed_hours), provenance=True,
    )
    return report_rows(homeowners_only(rows, homeowners), limit).select(
        *REPORT_COLUMNS, F.col("created_at").alias("first_seen"), "signals"
    )


def report_counts(
    signals: DataFrame, properties: DataFrame, as_of, hours: int = 24, homeowners: bool = True
) -> DataFrame:
    """Per type: newly filed, older or undated (backfill), and the newest filing among the new."""
    fresh = arrival_window(signals, as_of, hours)
    resolved = dedupe_resolved(fresh)
    parcels = properties.select("apn", F.col("owner_name").alias("p_owner"))
    rows = resolved.join(parcels, "apn", "left").unionByName(
        dedupe_unresolved(fresh), allowMissingColumns=True
    )
    owned = rows.withColumn("owner_name", F.coalesce("p_owner", "owner_name")).withColumn(
        "is_entity", T.is_entity_owner("owner_name")
    )
    cutoff = phoenix_cutoff(as_of, K.FILED_WINDOW_DAYS)
    new = F.coalesce(F.col("event_date") >= cutoff, F.lit(False))
    return (
        homeowners_only(owned, homeowners)
        .groupBy("signal_type")
        .agg(
            F.count_if(new).alias("n"),
            F.count_if(~new).alias("older_n"),
            F.max(F.when(new, F.col("event_date"))).alias("freshest"),
        )
        .orderBy(F.col("n").desc(), "signal_type")
    )


def fresh_vs_backfill(signals: DataFrame, as_of, days: int = K.FILED_WINDOW_DAYS) -> DataFrame:
    """Label every arrival; late or undated filings are kept, as backfill. Batch or stream."""
    new = F.coalesce(F.col("event_date") >= phoenix_cutoff(as_of, days), F.lit(False))
    return signals.withColumn("filing", F.when(new, "fresh").otherwise("backfill"))


def freshest_top3(counts: DataFrame) -> DataFrame:
    return (
        counts.where((F.col("n") > 0) & F.col("freshest").isNotNull())
        .orderBy(F.col("n").desc(), "signal_type")
        .limit(3)
    )


def report_totals(counts: DataFrame) -> DataFrame:
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("older_n"), F.lit(0)).alias("older_n"),
    )


def report_numbers(
    signals: DataFrame, properties: DataFrame, scores: DataFrame, as_of, limit: int | None = None,
):
    """One row: n24, n7, stacked, trustee sales after ten years of ownership (both over 7 days).

    All rows count. With a `limit` only the best rows of each report do, as a page that shows so
    many rows would count them.
    """
    def rows(hours: int, filed_hours: int | None) -> DataFrame:
        found = homeowners_only(_enriched(
            signals, properties, scores, as_of, hours, lambda s: filed_window_hours(s, as_of, filed_hours)))
        return found if limit is None else report_rows(found, limit)

    day = rows(24, None).agg(F.count("*"))
    week_rows = rows(168, 14 * 24)
    trustee = X.has_signal_type("signal_types", "trustee_sale")
    week = week_rows.agg(
        F.count("*").alias("n7"),
        F.count_if(F.col("stacked_types") >= 2).alias("stacked"),
        F.count_if(trustee & (F.coalesce("years_owned", F.lit(0)) >= 10)).alias("long_trustee"),
    )
    return week.withColumn("n24", day.scalar())


def hot_stacks(signals: DataFrame, properties: DataFrame, scores: DataFrame, as_of) -> DataFrame:
    """The three best homeowner parcels with two or more signal types in the last seven days."""
    rows = _enriched(signals, properties, scores, as_of, 168, lambda s: s)
    stacked = homeowners_only(rows).where(
        (F.col("stacked_types") >= 2) & F.col("apn").isNotNull()
        & F.col("situs_address").isNotNull()
    )
    return report_rows(stacked, 3).select(*REPORT_COLUMNS)


def resolved_leads_only(report: DataFrame) -> DataFrame:
    return report.where(
        (F.coalesce("apn", F.lit("")) != "") & (F.coalesce("situs_address", F.lit("")) != "")
    )


def masked_report(report: DataFrame, free_rows: int = 10) -> DataFrame:
    """The free view: the first rows, persons behind court cases reduced to initials."""
    seen = "created_at" if "created_at" in report.columns else "first_seen"
    return report.orderBy(*_report_order(seen)).limit(free_rows).withColumn(
        "owner_name",
        X.owner_initials_mask(
            "owner_name", F.coalesce("signal_types", "signal_type"), "is_entity"
        ),
    )
