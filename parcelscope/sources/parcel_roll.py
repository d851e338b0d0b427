"""The county parcel roll: pipe-delimited text without a header, 39 cells a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T

# Positions of the cells used, counted from 0.
CELLS = {
    "parcel": 0, "owner_name": 1, "mail_line1": 2, "mail_line2": 3, "mail_city": 4,
    "mail_state": 5, "mail_zip": 6, "situs_line": 8, "situs_suite": 9, "situs_city": 10,
    "situs_zip": 11, "property_type": 12, "deed_date": 14, "total_value": 18, "land_class": 26,
    "living_area": 29, "construction_year": 31, "sale_price": 33, "sale_date": 34,
}
CELL_COUNT = 39


def _tagged(lines: DataFrame) -> DataFrame:
    """Lines that aren't blank, with their named cells and the reason why a line is no parcel (else NULL)."""
    cells = F.split(F.regexp_replace("value", r"\r$", ""), r"\|", -1)
    split = lines.where(T.strip("value") != "").withColumn(
        "cells", cells
    )
    apn = T.normalize_apn(F.get("cells", F.lit(CELLS["parcel"])))
    reason = F.when(F.size("cells") < CELL_COUNT, "too few cells").when(apn == "", "no parcel")
    return split.select("value", reason.alias("reason"), *[T.strip(F.get("cells", F.lit(i))).alias(name) for name, i in CELLS.items()])


def parse_parcel_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(property rows, quarantined lines) of a DataFrame with a `value` column.

    Both sides are projections of the same scan; blank lines belong to neither.
    """
    tagged = _tagged(lines)
    bad = tagged.where(F.col("reason").isNotNull()).select("value", "reason")
    return _property_rows(tagged.where(F.col("reason").isNull())), bad


REASONS = ("too few cells", "no parcel")


def land_parcel_lines(lines: DataFrame, path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(property rows, quarantined lines, counts) after one pass over the lines: both kinds of rows are
    written to `path`, and how many there are of each kind is observed while they are written."""
    tagged = _tagged(lines)
    rows = _property_rows(tagged, F.when(F.col("reason").isNotNull(), F.col("value")).alias("bad_line"), F.col("reason"))
    seen = Observation("parcel roll")
    counted = rows.observe(seen, F.count_if(F.col("reason").isNull()).alias("parcels"),
                           *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS])
    counted.write.mode("overwrite").parquet(path)
    landed = lines.sparkSession.read.schema(rows.schema).parquet(path)
    good = landed.where(F.col("reason").isNull()).drop("bad_line", "reason")
    bad = landed.where(F.col("reason").isNotNull()).select(F.col("bad_line").alias("value"), "reason")
    return good, bad, seen.get


def _property_rows(c: DataFrame, *more: Column) -> DataFrame:
    sale = F.coalesce(D.parse_sale_date("sale_date"), D.parse_deed_date("deed_date"))
    return c.select(
        T.normalize_apn("parcel").alias("apn"),
        T.compose_situs_address("situs_line", "situs_suite").alias("situs_address"),
        T.blank_to_null("situs_city").alias("situs_city"),
        T.blank_to_null("situs_zip").alias("situs_zip"),
        F.col("owner_name"),
        T.normalize_owner_name("owner_name").alias("owner_name_norm"),
        T.compose_mailing_address(
            "mail_line1", "mail_line2", "mail_city", "mail_state", "mail_zip"
        ).alias("mailing_address"),
        T.absentee_flag(
            "mail_line1", "mail_city", "mail_zip", "situs_line", "situs_city", "situs_zip"
        ).alias("absentee"),
        T.blank_to_null("property_type").alias("building_type"),
        T.parse_legal_class("land_class").alias("legal_class"),
        T.year_built("construction_year").alias("year_built"),
        T.numeric_or_null("living_area").try_cast("int").alias("living_sqft"),
        sale.alias("last_sale_date"),
        T.numeric_or_null("sale_price").alias("last_sale_price"),
        T.numeric_or_null("total_value").alias("assessed_value"), *more,
    )


ROLL_FILES = "Secured_Master_BK*.txt"  # fixed value: names of the roll files


def roll_files(spark: SparkSession, path: str, names: str = ROLL_FILES) -> DataFrame:
    return spark.read.text(path, pathGlobFilter=names)


def scan_parcel_master(spark: SparkSession, path: str, names: str = ROLL_FILES) -> tuple[DataFrame, DataFrame]:
    """Property rows and quarantined lines of the roll files in a folder."""
    return parse_parcel_lines(roll_files(spark, path, names))


def quarantine_rows(bad: DataFrame) -> DataFrame:
    return bad.groupBy("reason").agg(F.count("*").alias("n"))
