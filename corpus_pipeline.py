"""The corpus pipeline: grade, drop copies, drop near copies, drop leaked benchmark texts, encode.

Every stage reads what its predecessor kept, written as Parquet. The first
four return rows of `documents` with all columns; the last returns each
document's token ids and the digests of its round trip.

Defined cases: as those of the operators; rows without a doc_id are judged by
their text, and kept by the near-dedup stage, which decides by id.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import bpe, decontaminate, exact_dedup, near_dedup, quality
from graphloom.llm.common import documents_of, table_of, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the best grade is at least one half."""
    return quality.keep_good(docs, table_of(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased), the largest doc_id."""
    return exact_dedup.drop_duplicates(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share 80 % of their five-word shingles, the smallest doc_id."""
    return near_dedup.keep_one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any overlap with the benchmark."""
    return decontaminate.drop_contaminated(docs, table_of(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids, their number, and whether they decode to the text: (doc_id, ids, n_tokens, decoded_sha256)."""
    ranks = bpe.default_ranks_path()

    def finish(doc_ids: list, ids: list[list[int]]) -> pa.RecordBatch:
        decoded = [hashlib.sha256(bpe.decode_ids(x, ranks)).hexdigest() for x in ids]
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64()), pa.array(decoded, pa.string())], names=["doc_id", "ids", "n_tokens", "decoded_sha256"])

    return bpe.map_encoded(docs, finish, "doc_id long, ids array<int>, n_tokens long, decoded_sha256 string", ranks)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE", encoding_stage),
]

#: The trained classifier, the tokens' hashes and BPE merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again before the next."""
    docs = documents_of(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
