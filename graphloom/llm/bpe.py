"""Byte-level BPE encoding and decoding with overlapping chunks.

A text longer than `chunk_chars` is cut into chunks that overlap by
`overlap_chars`; the chunks are spread over the cluster and pre-tokenised in
parallel. A chunk that starts in the middle of the text may begin with wrong
pre-tokens, but the pattern has no look-behind, so from the first boundary
that it shares with its predecessor on, its pre-tokens are the true ones. The
chunks are stitched at such a boundary (one after a character other than
white space, away from the chunk's end, so that neither look-ahead nor a run
cut short can matter); where an overlap has none, the two chunks become one
piece, so the result is exact for any text. The pieces are then encoded in
parallel, and a document's ids are those of its pieces in order. Decoding
concatenates the raw bytes of the ids.

Ranks and pattern are those of the caller (by default the public tokenizers
package); special tokens are never recognised.

Defined cases: null and empty texts have no tokens, and decode to nothing; an
empty table gives an empty result; repeated rows give repeated results; doc_id
may be null; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import id_and_text, text_parts, written

CHUNK_CHARS, OVERLAP_CHARS = 32_768, 1_024
#: Characters before a chunk's end within which a boundary may still move: the longest look-ahead of the pattern is two.
MARGIN = 3
VOCABULARY = "byte_bpe_50k.tiktoken"


def default_ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@lru_cache(maxsize=4)
def codec(ranks_path: str):
    """The encoding, made once in each process, and the decimal form of every id."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
    encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return encoding, [str(i) for i in range(max(ranks.values()) + 1)]


@lru_cache(maxsize=1)
def pretoken_pattern():
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN)


#: Characters that every Unicode version puts in the same class; texts are cut only between two of them.
SETTLED = regex.compile(r"[ \n!-~\u00c0-\u024f\u0391-\u044f\u3001-\u3029\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5]")


def boundaries(chunk: str) -> list[int]:
    """The ends of the chunk's pre-tokens."""
    return [m.end() for m in pretoken_pattern().finditer(chunk)]


def safe_boundaries(chunk: str, begin: int, last: bool, low: int, high: int) -> list[int]:
    """Boundaries within [low, high) of the text at which it can be cut: after a visible character, and certain. `begin` is the chunk's place."""
    most = len(chunk) if last else len(chunk) - MARGIN
    bounds = [b for b in boundaries(chunk) if b <= most and low <= begin + b < high and not chunk[b - 1].isspace()]
    return [begin + b for b in bounds if SETTLED.match(chunk, b - 1) and (b == len(chunk) or SETTLED.match(chunk, b))]


def piece_starts(chunks: list[tuple[int, list[int], list[int]]]) -> list[int]:
    """Where the pieces of a text start, from each chunk's (begin, boundaries in the overlap before, boundaries in the overlap after).

    A chunk's boundaries count only once it is in step with its
    predecessor; one that never gets in step, or whose predecessor is not,
    belongs to the piece before.
    """
    starts, before, in_step = [0], set(chunks[0][2]), True
    for begin, head, tail in chunks[1:]:
        common = sorted(before & set(head)) if in_step else []
        in_step = bool(common)
        if common:
            starts.append(common[0])
            before = set(tail)
    return starts


def encode_pieces(texts: list[str], ranks_path: str) -> list[list[int]]:
    encoding, _ = codec(ranks_path)
    return [encoding.encode_ordinary(t) for t in texts]


def decode_ids(ids: list[int], ranks_path: str) -> bytes:
    """The raw bytes of the ids, concatenated; they need not be valid UTF-8."""
    return codec(ranks_path)[0].decode_bytes(ids)


ENCODED = "doc_id long, ids array<int>"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _long_ids(long_docs: DataFrame, ranks_path: str, chunk_chars: int, overlap_chars: int) -> DataFrame:
    """(row_key, doc_id, place, ids): the encoded pieces of long texts."""
    step = chunk_chars - overlap_chars
    keyed = long_docs.select(F.monotonically_increasing_id().alias("row_key"), "doc_id", "text")
    keyed = written(keyed, "bpe-long")  # the keys stay what they are if a stage runs again

    def cut_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("row_key", pa.int64()), ("chars", pa.int32()), ("begin", pa.int32()), ("chunk", pa.string())])
        for part in text_parts(batches):
            for key, text in zip(part.column("row_key").to_pylist(), part.column("text").to_pylist()):
                begins = range(0, max(len(text) - overlap_chars, 1), step)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(begins)), pa.array([len(text)] * len(begins), pa.int32()), pa.array(list(begins), pa.int32()), pa.array([text[b : b + chunk_chars] for b in begins])], schema=schema)

    chunks = keyed.select("row_key", "text").mapInArrow(cut_chunks, "row_key long, chars int, begin int, chunk string").repartition("row_key", "begin")

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"row_key": [], "begin": [], "head": [], "tail": []}
            for key, chars, begin, chunk in zip(*(batch.column(c).to_pylist() for c in ("row_key", "chars", "begin", "chunk"))):
                last = begin + len(chunk) >= chars
                bounds = safe_boundaries(chunk, begin, last, begin, begin + len(chunk))
                out["row_key"].append(key)
                out["begin"].append(begin)
                out["head"].append([b for b in bounds if begin < b < begin + overlap_chars])
                out["tail"].append([b for b in bounds if b > begin + step])
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("row_key", pa.int64()), ("begin", pa.int32()), ("head", pa.list_(pa.int32())), ("tail", pa.list_(pa.int32()))]))

    seams = chunks.mapInArrow(pretokenise, "row_key long, begin int, head array<int>, tail array<int>")
    stitched = seams.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("begin", "head", "tail"))).alias("parts"))

    def cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int32()), ("text", pa.string())])
        for part in text_parts(batches):
            for key, doc, text, parts in zip(*(part.column(c).to_pylist() for c in ("row_key", "doc_id", "text", "parts"))):
                starts = piece_starts([(p["begin"], p["head"], p["tail"]) for p in parts])
                pieces = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(pieces), pa.int64()), pa.array([doc] * len(pieces), pa.int64()), pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.string())], schema=schema)

    cut = keyed.join(stitched, "row_key").select("row_key", "doc_id", "text", "parts")
    pieces = cut.mapInArrow(cut_pieces, "row_key long, doc_id long, place int, text string").repartition("row_key", "place")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_parts(batches):
            ids = encode_pieces(part.column("text").to_pylist(), ranks_path)
            yield pa.RecordBatch.from_arrays([part.column("row_key"), part.column("doc_id"), part.column("place"), pa.array(ids, pa.list_(pa.int32()))], names=["row_key", "doc_id", "place", "ids"])

    return pieces.mapInArrow(encode, "row_key long, doc_id long, place int, ids array<int>")


def map_encoded(docs: DataFrame, finish: Callable[[list, list[list[int]]], pa.RecordBatch], schema: str, ranks_path: str | None = None, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """finish(doc_ids, ids of each) over every whole text, some rows at a time; schema is that of its result."""
    ranks_path = ranks_path or default_ranks_path()
    rows = id_and_text(docs)

    def short_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_parts(batches):
            yield finish(part.column("doc_id").to_pylist(), encode_pieces(part.column("text").to_pylist(), ranks_path))

    def long_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                parts = batch.column("parts")[k].as_py()
                yield finish([batch.column("doc_id")[k].as_py()], [[i for p in parts for i in p["ids"]]])

    short = rows.filter(F.length("text") <= chunk_chars).mapInArrow(short_rows, schema)
    pieces = _long_ids(rows.filter(F.length("text") > chunk_chars), ranks_path, chunk_chars, overlap_chars)
    whole = pieces.groupBy("row_key").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("place", "ids"))).alias("parts"))
    return short.unionByName(whole.select("doc_id", "parts").mapInArrow(long_rows, schema))


def encode_documents(docs: DataFrame, ranks_path: str | None = None, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id and the token ids of every whole text."""
    finish = lambda doc_ids, ids: pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])
    return map_encoded(docs, finish, ENCODED, ranks_path, chunk_chars, overlap_chars)


def decode_documents(encoded: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """doc_id and the bytes of its ids."""
    ranks_path = ranks_path or default_ranks_path()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [decode_ids(ids.as_py() or [], ranks_path) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, data binary")


def round_trip_digests(docs: DataFrame, ranks_path: str | None = None, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by a space) and decoded_sha256 (bytes decoded from the ids) of every document."""
    ranks_path = ranks_path or default_ranks_path()

    def digest_rows(doc_ids: list, ids_lists: list[list[int]]) -> pa.RecordBatch:
        names = codec(ranks_path)[1]
        out = {"doc_id": doc_ids, "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for ids in ids_lists:
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decode_ids(ids, ranks_path)).hexdigest())
        return pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]))

    return map_encoded(docs, digest_rows, DIGESTS, ranks_path, chunk_chars, overlap_chars)
