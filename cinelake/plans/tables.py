"""Reading the landed tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = 8 << 20) -> DataFrame:
    """A side is broadcast only after its rows are counted; beyond the limit it joins by shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def written(df: DataFrame, name: str) -> DataFrame:
    """`df`, computed once into a Parquet table in the folder that driver and executors share (spark.checkpoint.dir): a lost executor costs a read. Only a
    local session, whose executors are this process, may do without the setting. The table goes when the driver's JVM ends."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cinelake-")
    path = f"{base.rstrip('/')}/cinelake/{uuid.uuid4().hex}/{name}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
