"""Helpers shared by the training-data operators: scratch tables, text slices, word hashes."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import shared_dir

#: Bytes of text that one vectorised step handles at most (a single longer text is a step of its own).
SLICE_BYTES = 3 << 20


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written as Parquet to the shared folder and read again: lineage ends here, and lost executors lose nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of written tables that nothing reads any more."""
    for table in tables:
        jvm = table.sparkSession._jvm
        for file in table.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)).getParent()
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def documents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only doc_id (long) and text (null: empty), so that other columns, whatever their names, take no part."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of the batch, so many at a time that their texts stay within `most` bytes."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends, begin = np.cumsum(sizes), 0
    del sizes
    while begin < len(ends):
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def give_back() -> None:
    """Returns freed memory to the system: workers outlive their tasks, and would hold what the largest one took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def text_parts(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in slices. Slices are copies, and no batch is held while the next one is read, so a worker never has two."""
    batches = iter(batches)
    while True:
        batch = next(batches, None)
        if batch is None:
            give_back()
            return
        for part in text_slices(batch, column, most):
            part = part.take(pa.array(np.arange(part.num_rows)))
            yield part
            del part
        del batch


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Offsets by row, the code of each word, and the distinct words that codes stand for. Words are runs without ASCII white space."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    filled = np.asarray(pc.greater(pc.binary_length(flat), 0))
    if not filled.all():
        offsets = np.concatenate([[0], np.cumsum(filled)])[offsets]
        flat = flat.filter(pa.array(filled))
    coded = flat.dictionary_encode()
    return offsets, np.asarray(coded.indices, dtype=np.int64), coded.dictionary


def hash_strings(values) -> np.ndarray:
    """A 64-bit hash of each string, the same in every process."""
    values = np.asarray(values, dtype=object)
    return pd.util.hash_array(values, categorize=False).astype(np.uint64) if len(values) else np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser that spreads all bits of x over the result."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` consecutive values (order counts)."""
    n = len(hashes) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return out


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of values[offsets[i]:offsets[i + 1]] for each i; 0 for empty rows."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[offsets])


#: Rows of (long, int) that are broadcast at most: some 20 MB.
BROADCAST_ROWS = 1_000_000


def broadcastable(labels: DataFrame) -> bool:
    """Whether the counted size of labels allows a broadcast."""
    return labels.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def with_labels(docs: DataFrame, labels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The documents that labels (keys, ...) has, with its columns. Labels are broadcast if their counted size allows, else both sides are shuffled."""
    small = labels.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(labels) if small else labels, keys or ["doc_id"])


def without_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that labels lacks; the counterpart of with_labels."""
    small = labels.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    ids = labels.select("doc_id")
    return docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_anti")


def drop_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id is none of ids (one column), with all their columns; rows without a doc_id stay. The name under which ids are joined is new each time, so no column can clash with it."""
    name = f"gone_{uuid.uuid4().hex}"
    gone = written(ids.toDF(name).filter(F.col(name).isNotNull()).distinct(), "gone")
    small = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if small else gone, docs["doc_id"].cast("long") == gone[name], "left_anti")


def hash_sample(labels: DataFrame, most: int) -> DataFrame:
    """About `most` rows, chosen by the hash of doc_id; all rows where there are fewer."""
    n = labels.count()
    return labels if n <= most else labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(most / n * (1 << 30)))


#: A group is hot when it has more than one row in this many; so there are fewer hot groups than this.
HOT_GROUPS = 2_000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """rows joined with the group of each (every row has one; groups come with their row counts).

    Groups with more than a 2,000th of all rows, fewer than 2,000 whatever the
    input, are broadcast, so their rows stay where they are; the others meet
    in a sort-merge join whose keys are all small. rows are read twice.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    hot = F.col(size) * HOT_GROUPS > int(total)
    if total < HOT_GROUPS or not groups.filter(hot).limit(1).count():
        return rows.join(groups.hint("merge"), keys)
    large = groups.filter(hot)
    few = rows.join(F.broadcast(large.select(*keys)), keys, "left_anti").join(groups.filter(~hot).hint("merge"), keys)
    return rows.join(F.broadcast(large), keys).unionByName(few)
