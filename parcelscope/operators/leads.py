"""Ranked leads, their signals, and the summary figures over scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import dates as D
from .score import score_breakdown_v1

_PARCEL = ["apn", "owner_name", "situs_address", "situs_city", "mailing_address", "absentee"]


def _filtered(scores, properties, city, min_score, hot_only) -> DataFrame:
    if hot_only:
        scores = scores.where("hot")
    if min_score is not None:
        scores = scores.where(F.col("score") >= min_score)
    parcels = properties.select(*_PARCEL)
    if city:
        parcels = parcels.where(F.contains(F.lower("situs_city"), F.lower(F.lit(city))))
    return scores.join(parcels, "apn")


def _best(rows: DataFrame, limit: int) -> DataFrame:
    return rows.orderBy(F.col("score").desc(), "apn").limit(limit)


def top_leads(
    scores: DataFrame, properties: DataFrame, limit: int = 25, city: str | None = None,
    min_score: int | None = None, hot_only: bool = False,
) -> DataFrame:
    rows = _filtered(scores, properties, city, min_score, hot_only)
    blank = F.lit("")
    return _best(rows, limit).select(
        "apn", "score", "hot", "signal_types",
        *[F.coalesce(c, blank).alias(c) for c in _PARCEL[1:5]],
        F.coalesce("absentee", F.lit(False)).alias("absentee"), "components",
    )


def lead_list(
    scores: DataFrame, properties: DataFrame, actions: DataFrame, limit: int = 50,
    city: str | None = None, min_score: int | None = None, hot: bool = False,
    include_hidden: bool = False, saved_only: bool = False,
) -> DataFrame:
    """Leads with saved flag and the undecayed score explanation.

    The signals of the returned leads are a table of their own, see lead_signals_attach.
    """
    marked = lambda a: actions.where(F.col("action") == a).select("apn").distinct()
    rows = scores
    if not include_hidden:
        rows = rows.join(marked("hidden"), "apn", "left_anti")
    if saved_only:
        rows = rows.join(marked("saved"), "apn", "left_semi")
    best = _best(_filtered(rows, properties, city, min_score, hot), limit)
    saved = marked("saved").withColumn("saved", F.lit(True))
    return best.join(saved, "apn", "left").select(
        "apn", "score", "hot", F.coalesce("saved", F.lit(False)).alias("saved"), "signal_types",
        "owner_name", "situs_address", "situs_city", "mailing_address",
        F.coalesce("absentee", F.lit(False)).alias("absentee"),
        F.col("components.latest_date").alias("latest_date"),
        score_breakdown_v1("components").alias("score_breakdown"),
    )


def lead_signals_attach(leads: DataFrame, signals: DataFrame) -> DataFrame:
    """Every signal of the listed leads, one row each, leads by rank and signals newest first.

    Rows instead of an array per lead: a lead may have any number of signals.
    """
    listed = leads.select("apn", "score")
    rows = signals.select("apn", "signal_type", "source", "external_id", "event_date", "observed_date")
    return rows.join(listed, "apn").orderBy(
        F.col("score").desc(), "apn", F.col("event_date").desc_nulls_last(), "source", "external_id"
    )


def fresh_in_scored(signals: DataFrame, scores: DataFrame, as_of, days: int) -> DataFrame:
    """Scored parcels with a signal filed in the last days; parcels are folded before the join."""
    since = F.date_sub(F.to_date(D.as_of_col(as_of)), days)
    recent = signals.where((F.col("event_date") >= since) & F.col("apn").isNotNull())
    return recent.select("apn").distinct().join(scores.select("apn"), "apn", "left_semi")


def summary_counts(scores: DataFrame, signals: DataFrame, as_of) -> DataFrame:
    """One row: scored, hot, parcels with a filing in the last 7 and 30 days."""
    today = F.to_date(D.as_of_col(as_of))
    newest = signals.where(
        F.col("apn").isNotNull() & (F.col("event_date") >= F.date_sub(today, 30))
    ).groupBy("apn").agg(F.max("event_date").alias("newest"))
    return scores.select("apn", "hot").join(newest, "apn", "left").agg(
        F.count("*").alias("scored"),
        F.count_if("hot").alias("hot"),
        F.count_if(F.col("newest") >= F.date_sub(today, 7)).alias("fresh_7"),
        F.count("newest").alias("fresh_30"),
    )


def summary_by_signal(scores: DataFrame) -> DataFrame:
    return (
        scores.select(F.explode("signal_types").alias("signal_type"))
        .groupBy("signal_type")
        .agg(F.count("*").alias("n"))
    )


def summary_top_cities(scores: DataFrame, properties: DataFrame, n: int = 8) -> DataFrame:
    cities = properties.where(F.col("situs_city").isNotNull()).select(
        "apn", F.col("situs_city").alias("city")
    )
    return (
        scores.select("apn").join(cities, "apn").groupBy("city")
        .agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), "city").limit(n)
    )


def signal_share(by_signal: DataFrame) -> DataFrame:
    """Each type's share of all. The input is one row per signal type."""
    total = by_signal.agg(F.sum("n")).scalar()
    return by_signal.select("signal_type", "n", (F.col("n") / total).alias("share"))


def city_centroid_fallback(leads: DataFrame, jitter: float = 0.04) -> DataFrame:
    """Approximate coordinates: the city's centre, spread by a hash of the parcel number."""
    key = F.regexp_replace(F.lower(F.coalesce("situs_city", F.lit(""))), r"\s+", "")
    lat, lon = F.lit(K.DEFAULT_CENTROID[0]), F.lit(K.DEFAULT_CENTROID[1])
    for city, (la, lo) in K.CITY_CENTROIDS.items():
        lat = F.when(F.col("city_key") == city, la).otherwise(lat)
        lon = F.when(F.col("city_key") == city, lo).otherwise(lon)
    digest = F.md5("apn")
    part = lambda start: F.conv(
        F.substring(digest, start, 8), 16, 10
    ).cast("double") / 4294967296.0
    return leads.withColumn("city_key", key).select(
        *leads.columns,
        (lat + (part(1) - 0.5) * jitter).alias("lat"),
        (lon + (part(9) - 0.5) * jitter).alias("lon"),
    )
