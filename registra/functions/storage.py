"""Folders and tables that a job keeps while it runs, where driver and executors all see them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one that spark.checkpoint.dir names; a temporary one only on a local master without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/registra-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a written table: what is read several times is worked out once, and survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt over as many tasks as a shuffle has, by a key: for work that takes long on each row. Well packed files hold very many rows in
    a few MB, which one task would read and then work on alone.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
