"""Dates, ages and time labels. Nothing here reads the clock: as_of is always given."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import as_col

PHOENIX = "America/Phoenix"


def as_of_col(as_of) -> Column:
    """A timestamp column from a datetime, an ISO string or a Column."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, dt.datetime):
        as_of = as_of.isoformat(sep=" ")
    return F.lit(str(as_of)).cast("timestamp")


def phoenix_date(ts) -> Column:
    return F.to_date(F.from_utc_timestamp(as_col(ts), PHOENIX))


def phoenix_day_bounds(ts) -> Column:
    """[start, end) of the Phoenix day of an instant, as a struct of UTC timestamps."""
    day = phoenix_date(ts)
    return F.struct(
        F.to_utc_timestamp(day.cast("timestamp"), PHOENIX).alias("start"),
        F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), PHOENIX).alias("end"),
    )


def parse_us_date(c) -> Column:
    """M/D/YYYY, with anything after the date ignored."""
    found = F.regexp_extract(as_col(c), r"^\s*(\d{1,2}/\d{1,2}/\d{4})(\s|$)", 1)
    return F.try_to_timestamp(F.nullif(found, F.lit("")), F.lit("M/d/yyyy")).cast("date")


def parse_deed_date(c) -> Column:
    """MMDDYYYY from 1900 on; a day that does not exist is NULL."""
    raw = F.when(as_col(c).rlike(r"^\d{8}$"), as_col(c))
    day = F.try_to_timestamp(raw, F.lit("MMddyyyy")).cast("date")
    return F.when(F.year(day) >= 1900, day)


def parse_sale_date(c) -> Column:
    """'MM YYYY' as the first of the month."""
    parts = F.split(F.trim(as_col(c)), r"\s+")
    month, year = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    ok = (F.size(parts) == 2) & month.rlike(r"^\d{1,2}$") & year.rlike(r"^\d{4}$")
    text = F.when(ok, F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lit("01")))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")


def epoch_ms_date(c) -> Column:
    """UTC day of an epoch in milliseconds; zero counts as missing."""
    return F.timestamp_millis(F.nullif(as_col(c).try_cast("bigint"), F.lit(0).cast("bigint"))).cast(
        "date"
    )


def iso_prefix_date(c) -> Column:
    return F.substring(as_col(c), 1, 10).try_cast("date")


def age_in_days(date, as_of) -> Column:
    """Whole 24 h days since UTC midnight of the date, never negative; NULL stays NULL."""
    seconds = F.unix_seconds(as_of_col(as_of)) - F.unix_seconds(as_col(date).cast("timestamp"))
    days = F.floor(seconds / 86400)
    return F.when(days.isNotNull(), F.greatest(F.lit(0).cast("bigint"), days))


def years_owned(sale_date, as_of) -> Column:
    days = F.datediff(F.to_date(as_of_col(as_of)), as_col(sale_date))
    return F.floor(days / 365).cast("int")


def est_auction_date(trustee_date) -> Column:
    return F.date_add(as_col(trustee_date), K.AUCTION_NOTICE_DAYS)


def days_to_auction(est_date, as_of) -> Column:
    return F.datediff(as_col(est_date), F.to_date(as_of_col(as_of)))


def auction_cell(est_date, as_of) -> Column:
    days = days_to_auction(est_date, as_of)
    rel = (
        F.when(days == 0, "today")
        .when(days > 0, F.concat(F.lit("in "), days, F.lit("d")))
        .otherwise(F.concat(F.abs(days), F.lit("d ago")))
    )
    cell = F.concat(as_col(est_date).cast("string"), F.lit(" est · "), rel)
    return F.coalesce(cell, F.lit("-"))


def short_date(d) -> Column:
    return F.date_format(as_col(d), "MMM d")


def _ago(n: Column, unit: str) -> Column:
    return F.concat(n, F.when(n == 1, f" {unit} ago").otherwise(f" {unit}s ago"))


def relative_time(ts, as_of) -> Column:
    seconds = F.unix_seconds(as_of_col(as_of)) - F.unix_seconds(as_col(ts).cast("timestamp"))
    days = F.floor(seconds / 86400)
    weeks, months, years = F.floor(days / 7), F.floor(days / 30), F.floor(days / 365)
    return (
        F.when(days < 1, "today")
        .when(days < 14, _ago(days, "day"))
        .when(weeks < 6, _ago(weeks, "week"))
        .when(months < 12, _ago(months, "month"))
        .when(days.isNotNull(), _ago(years, "year"))
    )


def days_left(ends_at, as_of) -> Column:
    micros = F.unix_micros(as_col(ends_at)) - F.unix_micros(as_of_col(as_of))
    days = F.ceil(micros / 86_400_000_000)
    return F.when(days.isNotNull(), F.greatest(F.lit(0).cast("bigint"), days))


def date_chunks(ranges, start, end, n: int):
    """Contiguous windows of n days that cover [start, end] of every row of ranges."""
    if n < 1:
        raise ValueError("n must be at least 1")
    starts = F.when(
        as_col(start) <= as_col(end),
        F.sequence(as_col(start), as_col(end), F.make_dt_interval(days=F.lit(n))),
    )
    return ranges.select("*", F.explode(starts).alias("chunk_start")).withColumn(
        "chunk_end", F.least(F.date_add("chunk_start", n - 1), as_col(end))
    )
