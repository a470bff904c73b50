"""Scratch tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of this machine for a local master; on a cluster executors would not share it, so that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that driver and executors share (master: {master})")
        path = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: an iterative plan is cut here, and lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes read that make a piece, some 600,000 edges; the most pieces.
PIECE, MOST_PIECES = 8 << 20, 4096
#: Sizes from here on are Spark's way to say that it knows none, as of rows that the driver made.
UNKNOWN = 1 << 60


def pieces(df: DataFrame) -> int:
    """Into how many parts to deal rows so that one part does not grow with the input: by the size of all that the plan reads (estimates of joins multiply), but not fewer than spark.sql.shuffle.partitions."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    size = sum(x for x in sizes if x < UNKNOWN)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // PIECE), MOST_PIECES), 1)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows of df dealt by keys into parts whose size does not grow with the input: what groups by these keys then needs no shuffle of its own, and no task holds more than its part."""
    return df.repartition(pieces(df), *keys)


def bucketed(df: DataFrame, key: str, name: str = "step") -> DataFrame:
    """The rows of df as a table in the shared folder, bucketed and sorted by key: a join by key reads it without a shuffle, however often."""
    spark = df.sparkSession
    buckets = pieces(df)
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
    return spark.table(table)
