"""Motivation scores: time-decayed weight per signal type, stacking, auction and parcel modifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import dates as D
from ..functions.display import dim
from ..functions.text import as_col


def latest_per_type(signals: DataFrame) -> DataFrame:
    """Newest date per (apn, signal_type); an undated signal counts from its arrival."""
    return (
        signals.where(F.col("apn").isNotNull())
        .groupBy("apn", "signal_type")
        .agg(F.max(F.coalesce("event_date", F.to_date("created_at"))).alias("latest_date"))
    )


def type_signals_rollup(latest: DataFrame) -> DataFrame:
    """Per parcel an array of (type, date). Its length is the number of distinct types."""
    entry = F.struct(F.col("signal_type").alias("type"), F.col("latest_date").alias("date"))
    return latest.groupBy("apn").agg(F.sort_array(F.collect_list(entry)).alias("type_signals"))


def score_join(rollup: DataFrame, properties: DataFrame) -> DataFrame:
    """Keep parcels of the spine, with the columns the modifiers need."""
    return rollup.join(
        properties.select("apn", "absentee", "assessed_value", "last_sale_date"), "apn"
    )


def decay_weight(base, age, half_life) -> Column:
    """Weight halved every half_life days; nothing beyond the age limit or without an age."""
    b, a, h = as_col(base), as_col(age), as_col(half_life)
    decayed = b * F.pow(F.lit(0.5), F.greatest(a, F.lit(0).cast("bigint")) / h)
    return F.when(a <= K.MAX_AGE_DAYS, decayed).otherwise(F.lit(0.0))


def is_live(decayed, base) -> Column:
    return F.coalesce(
        (as_col(base) > 0) & (as_col(decayed) >= as_col(base) * K.LIVE_SHARE), F.lit(False)
    )


def auction_info(date, as_of) -> Column:
    """struct(est_date, days_out, bonus, passed) of a trustee-sale notice."""
    est = D.est_auction_date(date)
    seconds = F.unix_seconds(est.cast("timestamp")) - F.unix_seconds(D.as_of_col(as_of))
    out = F.floor(seconds / 86400)
    bonus = F.when(out.between(0, 30), 20).when(out.between(31, 60), 10).otherwise(0)
    info = F.struct(
        est.alias("est_date"), out.alias("days_out"), bonus.alias("bonus"),
        (out < 0).alias("passed"),
    )
    return F.when(as_col(date).isNotNull(), info)


def equity_tenure_flags(last_sale_date, assessed_value, as_of) -> Column:
    """struct(high_equity, long_tenure) by the age of the last sale."""
    sale = as_col(last_sale_date).cast("timestamp")
    now = D.as_of_col(as_of)
    before = lambda years: sale.isNull() | (
        sale < now - F.make_ym_interval(years=F.lit(years))
    )
    return F.struct(
        (as_col(assessed_value).isNotNull() & before(10)).alias("high_equity"),
        before(15).alias("long_tenure"),
    )


def type_terms(latest: DataFrame, as_of, weights: dict = K.TYPE_WEIGHTS) -> DataFrame:
    """One row per (apn, type) with the terms the score adds up."""
    t = F.col("signal_type")
    trustee = t == "trustee_sale"
    return (
        latest.withColumns(
            {
                "base": F.coalesce(dim(weights, t), F.lit(0)),
                "half_life": F.coalesce(dim(K.HALF_LIFE_DAYS, t), F.lit(K.DEFAULT_HALF_LIFE)),
                "age_days": D.age_in_days("latest_date", as_of),
                "auction": F.when(trustee, auction_info("latest_date", as_of)),
            }
        )
        .withColumn("raw", decay_weight("base", "age_days", "half_life"))
        .withColumns(
            {
                "live": is_live("raw", "base"),
                "decayed": F.when(
                    F.col("auction.passed"), F.col("raw") * K.PASSED_AUCTION_SHARE
                ).otherwise(F.col("raw")),
                "bonus": F.coalesce("auction.bonus", F.lit(0)),
            }
        )
    )


def score_parcels(
    signals: DataFrame, properties: DataFrame, as_of, weights: dict = K.TYPE_WEIGHTS
) -> DataFrame:
    """apn, score, hot, signal_types, components, breakdown.

    Signals are folded to one row per (parcel, type) first, so everything after that is as large as
    the scored parcels however many signals one of them has.
    """
    terms = type_terms(latest_per_type(signals), as_of, weights)
    entry = F.struct("signal_type", "base", "age_days", "decayed", "live", "latest_date")
    per_parcel = terms.groupBy("apn").agg(
        F.sort_array(F.collect_list(entry)).alias("entries"),
        F.count_if("live").alias("live_count"),
        F.sum("bonus").alias("bonus"),
        F.min("age_days").alias("min_age"),
        F.max("latest_date").alias("latest_date"),
        F.max("auction").alias("auction"),
    )
    joined = score_join(per_parcel, properties).withColumn(
        "flags", equity_tenure_flags("last_sale_date", "assessed_value", as_of)
    )
    modifiers = F.struct(
        F.coalesce("absentee", F.lit(False)).alias("absentee"),
        F.col("flags.high_equity").alias("high_equity"),
        F.col("flags.long_tenure").alias("long_tenure"),
    )
    # Adding along the sorted array keeps the floating-point sum independent of partitioning.
    decayed = F.aggregate("entries", F.lit(0.0), lambda acc, e: acc + e["decayed"])
    points = sum(
        (F.when(F.col(f"modifiers.{m}"), p).otherwise(0) for m, p in K.MODIFIER_POINTS.items()),
        F.lit(0),
    )
    fresh = F.coalesce(F.col("min_age") <= K.FRESH_DAYS, F.lit(False))
    stack = F.greatest(F.col("live_count") - 1, F.lit(0).cast("bigint")) * K.STACK_POINTS
    total = (
        decayed + F.col("bonus") + stack + points
        + F.when(F.col("fresh"), K.FRESH_POINTS).otherwise(0)
    )
    return (
        joined.withColumns({"modifiers": modifiers, "fresh": fresh})
        .withColumn("score", F.floor(total + 0.5).cast("int"))
        .select(
            "apn", "score",
            ((F.col("score") >= K.HOT_SCORE) | (F.col("live_count") >= 2)).alias("hot"),
            F.transform("entries", lambda e: e["signal_type"]).alias("signal_types"),
            score_components().alias("components"),
            F.struct(
                F.map_from_entries(
                    F.transform(
                        "entries",
                        lambda e: F.struct(
                            e["signal_type"],
                            F.struct(
                                e["base"].alias("base"), e["age_days"].alias("age_days"),
                                e["decayed"].alias("decayed"), e["live"].alias("live"),
                            ),
                        ),
                    )
                ).alias("types"),
                F.col("modifiers"), F.col("auction"), F.col("fresh"), F.col("live_count"),
            ).alias("breakdown"),
        )
    )


def score_components() -> Column:
    return F.struct(
        F.transform("entries", lambda e: e["signal_type"]).alias("types"),
        F.col("modifiers"), F.col("fresh"), F.col("latest_date"),
    )


def score_distribution(scores: DataFrame) -> DataFrame:
    s = F.col("score")
    bucket = (
        F.when(s <= 25, "0-25").when(s <= 50, "26-50").when(s <= 75, "51-75").otherwise("76+")
    )
    return scores.groupBy(bucket.alias("bucket")).agg(
        F.count("*").alias("n"), F.count_if("hot").alias("n_hot")
    )


def top5_scores(scores: DataFrame) -> DataFrame:
    return (
        scores.select("apn", "score", "hot", F.array_join("signal_types", ",").alias("types"))
        .orderBy(F.col("score").desc(), "apn")
        .limit(5)
    )


def score_breakdown_v1(components) -> Column:
    """The undecayed explanation of a lead: array of (label, points)."""
    c = as_col(components)
    labels = {t: label for t, (label, _) in K.STATIC_TYPE_POINTS.items()}
    points = {t: p for t, (_, p) in K.STATIC_TYPE_POINTS.items()}
    item = lambda label, p: F.struct(
        label.alias("label"), p.cast("int").alias("points")
    )
    known = F.filter(c["types"], lambda t: t.isin(list(labels)))
    types = F.transform(known, lambda t: item(dim(labels, t), dim(points, t)))
    n = F.size(c["types"])
    none = F.array().cast("array<struct<label:string,points:int>>")
    one = lambda condition, entry: F.when(condition, F.array(entry)).otherwise(none)
    return F.concat(
        types,
        one(n > 1, item(F.lit("Signal stacking"), (n - 1) * K.STACK_POINTS)),
        *[
            one(c["modifiers"][m], item(F.lit(label), F.lit(p)))
            for m, (label, p) in K.STATIC_MODIFIER_POINTS.items()
        ],
        one(c["fresh"], item(F.lit("Fresh (last 30 days)"), F.lit(K.FRESH_POINTS))),
    )
