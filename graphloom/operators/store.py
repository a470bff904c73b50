"""Writes as set operations: upserts, deletes, corrections and versioned swaps of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.session import materialise

EDGE_IDENTITY = ("source", "target", "kind", "line", "col")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new over old: the last write wins."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys), keys, "left_anti")


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (source, target, kind, line, column), missing places counting as -1; the lowest id stays."""
    keys = [F.coalesce(F.col(k), F.lit(-1)) if k in ("line", "col") else F.col(k) for k in EDGE_IDENTITY]
    return edges.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("edge_id"))).filter("nth = 1").drop("nth")


def insert_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds edges whose ends exist. An edge that is there already takes the new metadata, so an inactive one comes back."""
    ids = nodes.select("id")
    valid = new.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)
    key = lambda df: df.withColumns({"line_key": F.coalesce("line", F.lit(-1)), "col_key": F.coalesce("col", F.lit(-1))})
    same = ["source", "target", "kind", "line_key", "col_key"]
    fresh = key(valid).select(*same, F.col("metadata").alias("new_metadata"), F.lit(True).alias("again")).dropDuplicates(same)
    updated = key(edges).join(fresh, same, "left").withColumn("metadata", F.when(F.col("again"), F.col("new_metadata")).otherwise(F.col("metadata"))).select(*edges.columns)
    added = key(distinct_edges(valid)).join(key(edges).select(*same), same, "left_anti").select(*edges.columns)
    return updated.unionByName(added)


def cascade(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends still exist. The ids that do are written once for both ends."""
    ids = materialise(nodes.select("id"), "ids")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)


def correct_edges(edges: DataFrame, corrections: DataFrame) -> DataFrame:
    """Applies (edge_id, action, new_target): retarget, suppress or verify; the correction is kept in the metadata."""
    joined = edges.join(corrections, "edge_id", "left")
    active = F.when(F.col("action") == "suppress", F.lit("false")).otherwise(F.lit("true"))
    audit = F.concat(F.lit('{"lsp":{"active":'), active, F.lit(',"action":"'), F.col("action"), F.lit('"'), F.when(F.col("action") == "retarget", F.concat(F.lit(',"from":"'), F.col("target"), F.lit('"'))).otherwise(F.lit("")), F.lit("}}"))
    return joined.select("edge_id", "source", F.when(F.col("action") == "retarget", F.col("new_target")).otherwise(F.col("target")).alias("target"), "kind", F.when(F.col("action").isNotNull(), audit).otherwise(F.col("metadata")).alias("metadata"), "line", "col", F.when(F.col("action").isNotNull(), F.lit("lsp")).otherwise(F.col("provenance")).alias("provenance"))


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The row of each key with the highest version."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))).filter("nth = 1").drop("nth")


class VersionedTable:
    """A table that is swapped whole: each write is a new folder, and a one-row pointer names the current one, written last."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> int:
        try:
            return self.spark.read.parquet(f"{self.path}/current").agg(F.max("version")).first()[0] or 0
        except Exception as error:  # the pointer does not exist before the first write
            if "PATH_NOT_FOUND" in str(error):
                return 0
            raise

    def swap(self, rows: DataFrame) -> int:
        """Writes the rows as the next version; readers see the old one until the pointer is there."""
        version = self.version() + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/v{version}")
        self.spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("append").parquet(f"{self.path}/current")
        return version

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self.version()}")


def upsert_vectors(old: DataFrame, new: DataFrame, meta: VersionedTable) -> DataFrame:
    """old over-written by new, one row for each node_id, and the counter vectors_version in meta raised by one where new has rows."""
    if new.limit(1).count():
        bump(meta, "vectors_version")
    return upsert(old, new, ["node_id"])


def metadata(meta: VersionedTable) -> dict[str, str]:
    """All keys of a table of settings."""
    return {r["key"]: r["value"] for r in meta.read().collect()} if meta.version() else {}


def set_metadata(meta: VersionedTable, key: str, value: str) -> None:
    rows = {**metadata(meta), key: value}
    meta.swap(meta.spark.createDataFrame(sorted(rows.items()), "key string, value string").coalesce(1))


def bump(meta: VersionedTable, key: str) -> int:
    """Raises a counter by one; it never falls."""
    value = int(metadata(meta).get(key, 0)) + 1
    set_metadata(meta, key, str(value))
    return value
