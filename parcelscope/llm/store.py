"""Written tables and files in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH, TEXTS_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder (as a URI) below `spark.checkpoint.dir`; a scratch folder only where that is
    unset and the session is local, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master or "").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = tempfile.mkdtemp(prefix="parcelscope-")
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{base}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: run once, and safe from lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # the table stands for the shuffles that made it
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def text_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) with fixed names, whatever other columns there are; a null text is empty.

    Texts are long, so they go to Python tasks in smaller batches than the default of 10,000 rows."""
    conf = docs.sparkSession.conf
    if int(conf.get(BATCH)) > TEXTS_PER_BATCH:
        conf.set(BATCH, str(TEXTS_PER_BATCH))
    return docs.select(
        docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")
    )


def open_store(uri: str):
    """(file system, path) of a shared folder, for tasks that write or read files of their own."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)
