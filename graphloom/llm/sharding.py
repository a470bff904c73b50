"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing.

Equal texts form a group that must stay in one shard. Each group is a partial
partition: one shard holds its bytes, the others nothing. Differencing
repeatedly takes the two partial partitions with the largest spread and
combines them oppositely ordered (the fullest part of one with the emptiest of
the other) until one partition is left.

At scale this runs as a tree: groups are dealt to buckets of bounded size by a
hash, every bucket is differenced in a task of its own, and the buckets'
partitions, which are partial partitions again, are differenced in the next
level in the same way. A bucket's result is `shards` sums, so the levels shrink
a thousandfold.

Law: `bytes`. Slots are gapless within a shard without gathering a shard in
one task: rows are numbered within (block, shard), and the counts of earlier
blocks are added.

Defined cases: null text has size 0 and counts as empty text for the groups;
a null doc_id is a row like any other; repeated rows share a shard and get
slots of their own; an empty table gives an empty result; a group larger than
a fair share makes its shard as large as the group; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import id_and_text, join_groups, written

SHARDS = 40
#: Bytes that each document takes besides its text.
ROW_BYTES = 16
#: Partial partitions in a bucket, about.
BUCKET_ITEMS = 20_000


def difference(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differencing of n partial partitions (n x shards sums).

    Returns placed (n x shards): the final part that each part of each
    partial partition goes to; and the final sums. Ties go to the earlier one.
    """
    n, shards = parts.shape
    nodes = [np.asarray(p, dtype=np.int64) for p in parts]
    joined: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    heap = [(-int(p.max() - p.min()), i) for i, p in enumerate(nodes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        down, up = np.argsort(-nodes[a], kind="stable"), np.argsort(nodes[b], kind="stable")
        total = nodes[a][down] + nodes[b][up]
        joined.append((a, b, down, up))
        nodes[a] = nodes[b] = None
        nodes.append(total)
        heapq.heappush(heap, (-int(total.max() - total.min()), len(nodes) - 1))
    placed: list[np.ndarray | None] = [None] * len(nodes)
    placed[-1] = np.arange(shards)
    for k in range(len(joined) - 1, -1, -1):
        a, b, down, up = joined[k]
        root = placed[n + k]
        placed[a], placed[b] = np.empty(shards, np.int64), np.empty(shards, np.int64)
        placed[a][down] = root
        placed[b][up] = root
    return np.vstack(placed[:n]), nodes[-1]


def difference_sizes(sizes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Differencing of single groups, each in the first part of its partial partition: the final part of each, and the sums."""
    parts = np.zeros((len(sizes), shards), np.int64)
    parts[:, 0] = sizes
    placed, sums = difference(parts)
    return placed[:, 0], sums


def text_key() -> list[Column]:
    """128 bits that stand for the text."""
    return [F.xxhash64("text").alias("key_a"), F.xxhash64(F.lit(1), F.col("text"), F.crc32("text")).alias("key_b")]


def _bucketed(groups: DataFrame, shards: int, load: np.ndarray | None) -> DataFrame:
    """(bucket, key_a, key_b, part) of every group and, with part -1, the sums of each bucket.

    load: what one bucket has to make up for, as the sums of one more partial
    partition; part k is then the one that holds load[k].
    """
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key_a", "key_b"], ascending=[False, True, True])
        parts = np.zeros((len(pdf) + (load is not None), shards), np.int64)
        parts[: len(pdf), 0] = pdf["size"].to_numpy()
        if load is not None:
            parts[-1] = load
        placed, sums = difference(parts)
        name = np.arange(shards) if load is None else np.argsort(placed[-1])
        out = pd.DataFrame({"bucket": pdf["bucket"].to_numpy(), "key_a": pdf["key_a"].to_numpy(), "key_b": pdf["key_b"].to_numpy(), "part": name[placed[: len(pdf), 0]], "sums": None})
        last = pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "key_a": [0], "key_b": [0], "part": [-1], "sums": [sums.tolist()]})
        return pd.concat([out, last], ignore_index=True)

    return groups.groupBy("bucket").applyInPandas(solve, "bucket long, key_a long, key_b long, part int, sums array<long>")


def _combined(sums: DataFrame, shards: int, fan_in: int) -> DataFrame:
    """One level up: (bucket, placed) of each partial partition within its bundle of `fan_in`, and (bundle, sums)."""
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket")
        placed, total = difference(np.vstack(pdf["sums"].to_list()))
        bundle = int(pdf["bundle"].iloc[0])
        out = pd.DataFrame({"bundle": bundle, "bucket": pdf["bucket"].to_numpy(), "placed": placed.tolist(), "sums": None})
        return pd.concat([out, pd.DataFrame({"bundle": [bundle], "bucket": [-1], "placed": [None], "sums": [total.tolist()]})], ignore_index=True)

    return sums.withColumn("bundle", F.floor(F.col("bucket") / fan_in).cast("long")).groupBy("bundle").applyInPandas(solve, "bundle long, bucket long, placed array<int>, sums array<long>")


def assign_groups(sized: DataFrame, shards: int = SHARDS, bucket_items: int = BUCKET_ITEMS, fan_in: int = 1_000) -> DataFrame:
    """(key_a, key_b, shard) for groups given as (key_a, key_b, size), a written table.

    A group larger than a bucket's fair share cannot be made up for within
    its bucket. Such groups (fewer than shards x buckets) are placed first,
    among themselves; every bucket then gets an equal part of their sums as
    one more partial partition, and so levels its part of the difference.
    """
    n, total = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(1, -(-n // bucket_items))
    load, first = None, None
    if buckets > 1:
        large = F.col("size") * (shards * buckets) > int(total)
        if sized.filter(large).limit(1).count():
            few = sized.filter(large).select("key_a", "key_b", "size")
            first = written(few.join(assign_groups(few, shards, bucket_items, fan_in), ["key_a", "key_b"]), "shard-large")
            held = {r["shard"]: r["s"] for r in first.groupBy("shard").agg(F.sum("size").alias("s")).collect()}  # a row for each shard
            load = np.array([held.get(k, 0) // buckets for k in range(shards)], np.int64)
            sized = sized.filter(~large)
    solved = written(_bucketed(sized.withColumn("bucket", F.pmod(F.xxhash64("key_b", "key_a"), F.lit(buckets))), shards, load), "shard-buckets")
    inner = solved.filter("part >= 0").select("key_a", "key_b", F.col("bucket").alias("leaf"), "part")
    if first is not None:
        return inner.select("key_a", "key_b", F.col("part").alias("shard")).unionByName(first.select("key_a", "key_b", "shard"))
    placement = solved.filter("part < 0").select(F.col("bucket").alias("leaf"), F.sequence(F.lit(0), F.lit(shards - 1)).alias("placed"), F.col("bucket").alias("top"))
    sums, width = solved.filter("part < 0").select("bucket", "sums"), buckets
    while width > 1:
        level = written(_combined(sums, shards, fan_in), "shard-level")
        step = level.filter("bucket >= 0").select(F.col("bucket").alias("top"), F.col("placed").alias("step"), "bundle")
        placement = placement.join(step, "top").select("leaf", F.transform("placed", lambda p: F.get("step", p)).alias("placed"), F.col("bundle").alias("top"))
        sums, width = level.filter("bucket < 0").select(F.col("bundle").alias("bucket"), "sums"), -(-width // fan_in)
    return inner.join(placement, "leaf").select("key_a", "key_b", F.get("placed", F.col("part")).cast("int").alias("shard"))


def with_slots(rows: DataFrame, order: list[str], blocks: int) -> DataFrame:
    """Adds slot: 0, 1, ... within each shard. Rows are numbered within (block, shard) and moved up by the counts of earlier blocks."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    counts = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("before"))
    numbered = rows.withColumn("nth", F.row_number().over(Window.partitionBy("block", "shard").orderBy(*order)) - 1)
    return numbered.join(before, ["block", "shard"]).withColumn("slot", F.col("before") + F.col("nth")).drop("block", "before", "nth")


def shard_documents(docs: DataFrame, shards: int = SHARDS, bucket_items: int = BUCKET_ITEMS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    spark = docs.sparkSession
    rows = id_and_text(docs).select("doc_id", (F.octet_length("text") + ROW_BYTES).cast("long").alias("size"), F.crc32("text").alias("text_crc32"), *text_key())
    rows = written(rows, "shard-rows")
    groups = written(rows.groupBy("key_a", "key_b").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")), "shard-groups")
    homes = groups.select("key_a", "key_b", "rows").join(assign_groups(groups, shards, bucket_items), ["key_a", "key_b"])
    placed = join_groups(rows, homes, ["key_a", "key_b"], "rows")
    blocks = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = with_slots(placed.select("doc_id", "size", "text_crc32", "shard"), ["doc_id", "text_crc32", "size"], blocks)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
