"""Tables laid out by parcel number, so that joins and groupings on it read them without a shuffle.

Both sides of a join must be written with the same number of buckets. A parcel's rows lie in one bucket;
rows without a parcel number share one too, so `by_parcel` keeps them apart.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder

KEY = "apn"
BUCKETS = 64
ROWS_A_BUCKET = 250_000
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def buckets_for(rows: int, least: int = 8) -> int:
    """As many buckets as keep one to about ROWS_A_BUCKET rows, a busy parcel's apart."""
    return max(least, -(-rows // ROWS_A_BUCKET))


def bucketed(df: DataFrame, name: str, key: str = KEY, buckets: int = BUCKETS) -> DataFrame:
    """df as a table bucketed by the key, at a new place in the shared folder.

    Rows are dealt to the buckets once, so that each bucket is one file. A task has the rows of one bucket,
    so it writes them as they come: a sort would hold the bucket in memory, and readers sort what they need."""
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    table = f"{name}_{mark}"
    before = spark.conf.get(WRITERS)
    spark.conf.set(WRITERS, "4")
    try:
        (df.repartition(buckets, key).write.bucketBy(buckets, key)
         .option("path", f"{shared_folder(spark)}/{name}-{mark}").saveAsTable(table))
    finally:
        spark.conf.set(WRITERS, before)
    return spark.table(table)


def by_parcel(df: DataFrame, name: str, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """(rows with a parcel number as a bucketed table, rows without one)."""
    return bucketed(df.where(F.col(KEY).isNotNull()), name, buckets=buckets), df.where(F.col(KEY).isNull())
