"""Exact deduplication against a persistent digest index (DataFrame functions only).

The index is a Parquet table bucketed and sorted by the SHA-256 of the
normalised text. New documents come in batches. Each is first reduced to one row
per digest (with map-side combination, so a text that fills a third of all rows
costs one row a task), then held against the index by a sort-merge anti-join
that does not shuffle the index, and only digests not known yet are appended.
Who comes first stays: batches go from the largest ids to the smallest, so of
equal texts the largest id is the one that the index keeps.

Normalised text: lower-cased A-Z only; null counts as empty.

Defined cases: an empty table gives an empty result; equal texts with several
ids keep the largest id, or the id that the index held before; a null doc_id
never wins over another id, and where all ids of a group are null its rows are
kept; rows that repeat both doc_id and text share their fate, and a doc_id with
several texts is judged for each of them; extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import BROADCAST_ROWS, discard, id_and_text, join_groups, scratch_path, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text with A-Z lower-cased, in UTF-8."""
    return F.sha2(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), 256)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every document."""
    return id_and_text(docs).select("doc_id", text_digest(F.col("text")).alias("digest"))


def digest_groups(rows: DataFrame) -> DataFrame:
    """(digest, keep_id): one row per digest; the largest doc_id stays."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))


class DigestIndex:
    """A persistent table of known digests under `path`, in `buckets` buckets sorted by digest.

    Opening a path that already holds an index attaches to it, so the index
    outlives the session; the number of buckets must be the one it was made with.
    """

    SCHEMA = "digest string, keep_id long"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.table} ({self.SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    def known(self) -> DataFrame:
        return self.spark.table(self.table)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The groups whose digest the index lacks: a sort-merge anti-join; the bucketed side is read without a shuffle."""
        new = groups.repartition(self.buckets, "digest").hint("merge")
        return new.join(self.known().select("digest").hint("merge"), "digest", "left_anti").select("digest", "keep_id")

    def append(self, groups: DataFrame) -> None:
        """Adds the groups that are new; run again after a failure, it adds nothing twice."""
        fresh = self.unseen(groups)
        fresh.write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.table)
        self.spark.catalog.refreshTable(self.table)

    def kept(self, sizes: DataFrame) -> DataFrame:
        """sizes (digest, group_size) with the keep_id of each digest; the bucketed side is read without a shuffle."""
        return sizes.repartition(self.buckets, "digest").hint("merge").join(self.known().hint("merge"), "digest").select("digest", "keep_id", "group_size")

    def close(self) -> None:
        """Forgets the table's name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def newest_first(rows: DataFrame, batches: int) -> list[DataFrame]:
    """The rows in some batches of about equal size, larger ids before smaller ones and null ids last."""
    cuts = rows.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)])).first()[0] if batches > 1 else None
    cuts = sorted(set(cuts or []), reverse=True)
    out, above = [], F.lit(True)
    for cut in cuts:
        out.append(rows.filter(above & (F.col("doc_id") >= cut)))
        above = F.col("doc_id") < cut
    return [*out, rows.filter(above | F.col("doc_id").isNull())]


def assign_survivors(docs: DataFrame, index: DigestIndex | None = None, batches: int = 2) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size (rows of the text in docs), kept, text_sha256.

    Without an index, a new one is made in the scratch folder. With one that
    already holds digests, documents whose text is known get the id that it
    keeps. Hot digests are joined where their documents are, the others by
    sort-merge.
    """
    spark = docs.sparkSession
    rows = written(digests(docs), "digests")
    own = index is None
    index = index or DigestIndex(spark, scratch_path(spark, "digest-index"), max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    for batch in newest_first(rows, batches):
        new = written(digest_groups(batch), "digest-new")  # written, because the optimiser would take the anti-join below the aggregate and shuffle every copy
        index.append(new)
        discard(new)
    groups = written(index.kept(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))), "digest-groups")
    if own:
        discard(index.known())
        index.close()
    out = join_groups(rows, groups, ["digest"], "group_size")
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull() & F.col("doc_id").isNull()).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The documents that stay, with all their columns. What goes is named by id and text, so other texts of the same id stay; only that is joined with the documents."""
    name, mark = f"gone_{uuid.uuid4().hex}", f"mark_{uuid.uuid4().hex}"
    gone = assign_survivors(docs, index).filter(~F.col("kept")).select(F.col("doc_id").alias(name), F.xxhash64("text_sha256").alias(mark)).distinct()
    gone = written(gone, "gone")
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    same = docs["doc_id"].cast("long").eqNullSafe(gone[name]) & (F.xxhash64(text_digest(docs["text"])) == gone[mark])
    return docs.join(F.broadcast(gone) if few else gone, same, "left_anti")


ORACLE_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""
