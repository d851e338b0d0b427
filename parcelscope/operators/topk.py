"""Small building blocks for ordered groups that stay safe on hot groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def first_rows(df: DataFrame, keys: list, order: list[Column], n: int = 1, rank: str | None = None):
    """The first n rows of every group.

    Written as row_number() <= n, so Spark drops all but n rows of a group inside each map task
    before the shuffle: a hot group never reaches one task whole.
    """
    name = rank or "__rn"
    window = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def numbered_rows(df: DataFrame, group: str, position: str, tie: str, name: str = "rn") -> DataFrame:
    """row_number() within `group` by (position, tie), rows without a position first.

    Rows are dealt by ranges of (group, position, tie), numbered inside a range, and shifted by the
    counts of the ranges before. Ties and missing positions are spread by `tie` like any other
    rows, and the number of ranges follows the session's partitions.
    """
    order = [F.col(position).asc_nulls_first(), F.col(tie).asc()]
    ranged = df.repartitionByRange(F.col(group).asc_nulls_first(), *order)
    # Written, so that the range of a row is the same wherever it is read below.
    ranged = cut_lineage(ranged.withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        ranged.groupBy(group, "__range").agg(F.count("*").alias("__n"))
        .withColumn("__shift", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .select(F.col(group).alias("__g"), F.col("__range").alias("__r"), "__shift")
    )
    inside = Window.partitionBy(group, "__range").orderBy(*order)
    numbered = ranged.withColumn("__rn", F.row_number().over(inside))
    same = F.col(group).eqNullSafe(F.col("__g")) & (F.col("__range") == F.col("__r"))
    return (
        numbered.join(shifts, same)
        .withColumn(name, F.col("__rn") + F.col("__shift"))
        .drop("__g", "__r", "__rn", "__shift", "__range")
    )
