"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# The JVM never compiles a method of more than 8000 bytes, so wide generated stages ran interpreted. Above
# the limit Spark leaves whole-stage code for one method per expression, which is compiled.
HUGE_METHOD = ("spark.sql.codegen.hugeMethodLimit", "8000")


def get_spark(app_name: str = "parcelscope", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **dict([HUGE_METHOD]),
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`, which every executor reaches; a scratch folder only where that is
    unset and all of the session runs in this process."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master or ""
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="parcelscope-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def cut_lineage(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder: it runs once, a lost executor cannot lose it, and
    readers take only the columns they need."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
