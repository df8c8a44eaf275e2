"""What the training-data operators share: the shared scratch folder, table access and held-out rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which every executor can reach, made known to ``checkpoint()``.

    Where the session has no such setting a temporary folder takes its place, on a local master only: on a cluster the other
    machines would not see it, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not base and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(base or "file://" + tempfile.mkdtemp(prefix="spark-"))
    return base or context.getCheckpointDir()


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below the checkpoint folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/registra-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """``df`` as a written table: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_table(df: DataFrame, path: str) -> None:
    """Deletes a table written below the checkpoint folder, once nothing reads it any more."""
    jvm, context = df.sparkSession._jvm, df.sparkSession.sparkContext
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the quarter of the rows that no label may be learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession, model: object) -> Broadcast:
    """A broadcast of a fitted model, of bounded size, with its class: ``pickle.loads(it.value)`` needs no installed package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))
