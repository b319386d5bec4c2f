"""Tables written between the steps of a job, in a folder that the driver and all executors see."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, or under the warehouse where that is unset (local tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/quaero-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written and read back: its lineage is cut, it is computed once, and Spark knows its true size."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables of up to so many rows, counted first, are broadcast by `sized`.
BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame) -> DataFrame:
    """df, written and counted, with the hint of its join: broadcast up to BROADCAST_ROWS, a sort-merge join beyond."""
    df = stored(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("shuffle_merge")
