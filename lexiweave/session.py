"""Session settings and table loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def build_session(app: str = "lexiweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    AQE coalesces and splits shuffle partitions at run time, so the static
    partition count only has to be an upper estimate.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
        "spark.ui.enabled": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test or production table; a file and a folder of files read alike.

    Timestamps without zone are read as they are, so results compare with
    other engines without a shift.
    """
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batch_rows(spark: SparkSession) -> int:
    """Rows per Arrow batch handed to Python workers in this session."""
    return int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """An empty frame of the schema."""
    return spark.createDataFrame([], schema)


def int_keys(df: DataFrame, *cols: str) -> DataFrame:
    """Casts the columns to BIGINT, which every surrogate key here is."""
    return df.withColumns({c: F.col(c).cast("bigint") for c in cols})
