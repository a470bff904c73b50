"""Plug-in surfaces: what users add to extraction, routes, embedding, filtering and labelling, by name.

Registered functions are shipped to executors with the jobs that use them, so
they must be picklable; names are unique within a surface, and the last
registration counts.
"""

from __future__ import annotations

import hashlib
import json
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Registry:
    """extractors: language to f(path, source) -> the row of sources.extract; frameworks: name to f(files) -> (path, framework, method, route); providers: name to EmbeddingProvider; filters: name to a Column over nodes; labellers: name to f(list of paths) -> label."""

    extractors: dict[str, Callable[[str, str], dict]] = field(default_factory=dict)
    frameworks: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    providers: dict[str, EmbeddingProvider] = field(default_factory=dict)
    filters: dict[str, Column] = field(default_factory=dict)
    labellers: dict[str, Callable[[list[str]], str]] = field(default_factory=dict)


@dataclass(frozen=True)
class EmbeddingProvider:
    """Texts to vectors of `dims` numbers, a batch at a time; model names what made them."""

    model: str
    dims: int
    embed: Callable[[list[str]], list[list[float]]]
    batch: int = 64


def hashed_words(dims: int = 64) -> EmbeddingProvider:
    """A provider without a model: signed counts of hashed words, of length one. For tests and for machines without a network."""
    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * dims
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[h % dims] += 1.0 if h >> 63 else -1.0
            norm = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / norm for x in v])
        return out

    return EmbeddingProvider(f"hashed-words-{dims}", dims, embed)


def endpoint(url: str, model: str, dims: int, seconds: float = 30.0, batch: int = 64) -> EmbeddingProvider:
    """A provider behind an HTTP endpoint that takes {"model", "input"} and answers {"data": [{"index", "embedding"}]}."""
    def embed(texts: list[str]) -> list[list[float]]:
        asked = urllib.request.Request(url, json.dumps({"model": model, "input": texts}).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(asked, timeout=seconds) as answer:
            data = sorted(json.load(answer)["data"], key=lambda d: d["index"])
        if len(data) != len(texts) or any(len(d["embedding"]) != dims for d in data):
            raise ValueError(f"the endpoint gave {len(data)} vectors for {len(texts)} texts, or not of {dims} numbers")
        return [d["embedding"] for d in data]

    return EmbeddingProvider(model, dims, embed, batch)


def embed_nodes(inputs: DataFrame, provider: EmbeddingProvider, known: DataFrame | None = None) -> DataFrame:
    """(node_id, model, dims, vector, input_hash) of inputs (id, input, input_hash); those that known vectors of the model have with the same hash are left out."""
    todo = inputs
    if known is not None:
        same = known.filter(F.col("model") == provider.model).select(F.col("node_id").alias("id"), "input_hash")
        todo = inputs.join(same, ["id", "input_hash"], "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, provider.batch):
                part = batch.slice(k, provider.batch)
                vectors = provider.embed(part.column("input").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([provider.model] * part.num_rows), pa.array([provider.dims] * part.num_rows, pa.int32()), pa.array(vectors, pa.list_(pa.float32())), part.column("input_hash")], names=["node_id", "model", "dims", "vector", "input_hash"])

    return todo.select("id", "input", "input_hash").mapInArrow(run, "node_id string, model string, dims int, vector array<float>, input_hash string")


def vector_state(vectors: DataFrame, model: str) -> tuple[str, int, int, str]:
    """(model, count, dims, mark) of a model's vectors: what a cache compares to know whether it is stale. The mark changes with any input hash."""
    mine = vectors.filter(F.col("model") == model)
    r = mine.agg(F.count(F.lit(1)).alias("n"), F.max("dims").alias("dims"), F.coalesce(F.bit_xor(F.xxhash64("node_id", "input_hash")), F.lit(0)).alias("mark")).first()
    return model, r["n"], r["dims"] or 0, f"{r['mark'] & (1 << 64) - 1:016x}"


def label_clusters(members: DataFrame, labeller: Callable[[list[str]], str]) -> DataFrame:
    """(community, display_label) by a registered labeller, a cluster's paths in order; a labeller that fails leaves null."""
    def name(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            label = labeller(sorted(pdf["path"]))
        except Exception:  # a labeller is advice: clusters have canonical labels without it
            label = None
        return pd.DataFrame({"community": pdf["community"].iloc[:1], "display_label": [label]})

    return members.select("community", "path").groupBy("community").applyInPandas(name, "community string, display_label string")


REGISTRY = Registry()
