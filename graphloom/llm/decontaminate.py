"""Benchmark decontamination by spaced seeds.

Every token window of a document is hashed through fixed masks that ignore
selected positions, and looked up among the benchmark's windows hashed through
the same masks (a broadcast hash join: documents never move); a substituted
token therefore spoils a seed only where a mask looks. Around every hit the two texts are laid side by side on the hit's
diagonal and the longest stretch with at least MIN_SHARE of its length equal is
taken; no other such stretch has more equal tokens. With at least MIN_MATCHED
equal tokens it is an overlap; so is one that covers a whole item shorter than
that, if it has MIN_ITEM tokens.

Tokens: lower-cased words without punctuation at their edges.

The benchmark is read in portions of at most PORTION_BYTES, whatever its size;
each portion is one broadcast and one pass over the documents, without a
shuffle.

Where several diagonals of a document and an item have stretches with equally
many tokens, the one with more equal tokens in all counts, then the first.

Defined cases: null and empty texts overlap with nothing; items under MIN_ITEM
tokens are never matched; repeated rows report alike, a null doc_id included;
empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import hash_strings, id_and_text, mix, split_words, text_parts

#: Fixed masks: 1 looks, 0 ignores. Any stretch with MIN_MATCHED equal tokens and a share of MIN_SHARE has a hit of one of them. Of 20 equal tokens or more, one half has the share too, so stretches of at most 19 equal tokens prove it, and tests go through them all.
MASKS = ("111111", "1101011", "11001011", "110010001011", "11100010011", "1110101001")
MIN_MATCHED, MIN_SHARE, MIN_ITEM = 10, 0.75, 6
#: What another token costs in the chains that the tests' brute force extends; verification goes by MIN_SHARE alone.
MISMATCH = 2
PORTION_BYTES = 32 << 20
FILTER_BITS = 22
#: Hits that are joined at a time, and cells of a comparison of diagonals with an item.
HITS, CELLS = 500_000, 1_000_000
EDGES = ".,;:!?|#$%&*\"'()[]{}<>«»„“”‘’…-_/\\=+~^`"
ODD = [np.uint64(0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * k & 0xFFFFFFFFFFFFFFFF) for k in range(16)]


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets by row and the hash of every token."""
    offsets, codes, words = split_words(texts)
    names = [w.lower().strip(EDGES) for w in words.to_pylist()]
    filled = np.array([bool(x) for x in names], dtype=bool)[codes] if len(names) else np.zeros(0, bool)
    return np.concatenate([[0], np.cumsum(filled)])[offsets], hash_strings(names)[codes][filled]


def seeds(hashes: np.ndarray, mask: str, number: int) -> np.ndarray:
    """The hash of every window through the mask; windows may span rows, which the caller sorts out."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, number, np.uint64)
    for k, look in enumerate(mask):
        if look == "1":
            out += hashes[k : k + n] * ODD[k]
    return mix(out)


def best_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """(begin, end, matched) of the longest stretch with a share of MIN_SHARE equal, without unequal tokens at its ends.

    It has the most equal tokens of all such stretches: one with more would
    still have the share when longer than this one.
    """
    score = np.concatenate([[0.0], np.cumsum(np.where(equal, 1 - MIN_SHARE, -MIN_SHARE))])
    begins = np.searchsorted(-np.minimum.accumulate(score), -score, side="left")
    end = int(np.argmax(np.arange(len(score)) - begins))
    begin = int(begins[end])
    at = np.flatnonzero(equal[begin:end])
    return (begin + int(at[0]), begin + int(at[-1]) + 1, len(at)) if len(at) else (0, 0, 0)


@dataclass
class Benchmark:
    """A portion of the benchmark: its tokens, and its seeds sorted by hash with the place of each."""

    item_ids: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray
    seed: np.ndarray
    place: np.ndarray
    filter: np.ndarray

    @classmethod
    def of(cls, item_ids: list[int], texts: list[str]) -> Benchmark:
        offsets, hashes = tokens(pa.array(texts, pa.string()))
        row = np.repeat(np.arange(len(texts)), np.diff(offsets))
        found, places = [], []
        for number, mask in enumerate(MASKS):
            s = seeds(hashes, mask, number)
            inside = row[: len(s)] == row[len(mask) - 1 :] if len(s) else np.zeros(0, bool)
            found.append(s[inside])
            places.append(np.flatnonzero(inside))
        seed, place = np.concatenate(found), np.concatenate(places)
        order = np.argsort(seed, kind="stable")
        table = np.zeros(1 << FILTER_BITS, bool)
        table[(seed >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        return cls(np.asarray(item_ids, dtype=np.int64), offsets, hashes, seed[order], place[order], table)

    def diagonals(self, offsets: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, shift) of every diagonal with a hit, sorted. Hits are joined HITS at a time, and those of one diagonal count once, so frequent seeds on both sides stay bounded."""
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        item_row = np.repeat(np.arange(len(self.item_ids)), np.diff(self.offsets))
        held = np.zeros((0, 3), np.int64)
        for number, mask in enumerate(MASKS):
            s = seeds(hashes, mask, number)
            at = np.flatnonzero(self.filter[(s >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            at = at[row[at] == row[at + len(mask) - 1]]
            low, n = np.searchsorted(self.seed, s[at], "left"), np.searchsorted(self.seed, s[at], "right")
            n -= low
            at, low, n = at[n > 0], low[n > 0], n[n > 0]
            ends = np.cumsum(n)
            for begin in range(0, int(ends[-1]) if len(ends) else 0, HITS):
                hit = np.arange(begin, min(begin + HITS, int(ends[-1])))
                of = np.searchsorted(ends, hit, "right")
                place = self.place[low[of] + hit - (ends[of] - n[of])]
                where = at[of]
                found = np.stack([row[where], item_row[place], (where - offsets[row[where]]) - (place - self.offsets[item_row[place]])], axis=1)
                held = np.concatenate([held, found])
                held = held[np.lexsort(held.T[::-1])]
                held = held[np.concatenate([[True], (held[1:] != held[:-1]).any(axis=1)])]
        return held[:, 0], held[:, 1], held[:, 2]

    def overlaps(self, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(row, item_id, first token, end token, matched) for each row and item that overlap: the longest stretch of the diagonal where most tokens are equal in it."""
        offsets, hashes = tokens(texts)
        row, item, shift = self.diagonals(offsets, hashes)
        out = []
        begins = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(item) != 0)])) if len(row) else row
        for first, last in zip(begins.tolist(), [*begins[1:].tolist(), len(row)]):
            r, i = int(row[first]), int(item[first])
            theirs = self.hashes[self.offsets[i] : self.offsets[i + 1]]
            if len(theirs) >= MIN_ITEM:
                best = best_overlap(hashes[offsets[r] : offsets[r + 1]], theirs, shift[first:last])
                if best:
                    out.append((r, int(self.item_ids[i]), *best))
        return out


def best_overlap(ours: np.ndarray, theirs: np.ndarray, shifts: np.ndarray) -> tuple[int, int, int] | None:
    """(first token, end token, matched) of the overlap with most equal tokens on any of the diagonals; a diagonal is looked at only while it has more equal tokens in all than the best stretch so far."""
    k = np.arange(len(theirs))
    step = max(1, CELLS // len(theirs))
    total = np.zeros(len(shifts), np.int64)
    for begin in range(0, len(shifts), step):
        at = shifts[begin : begin + step, None] + k[None, :]
        inside = (at >= 0) & (at < len(ours))
        total[begin : begin + step] = ((ours[np.where(inside, at, 0)] == theirs[None, :]) & inside).sum(axis=1)
    best, least = None, min(MIN_MATCHED, len(theirs))
    for d in np.argsort(-total, kind="stable").tolist():
        if total[d] < least:
            break
        shift = int(shifts[d])
        begin, end = max(0, -shift), min(len(theirs), len(ours) - shift)
        b, e, matched = best_stretch(theirs[begin:end] == ours[begin + shift : end + shift])
        if matched >= least:
            best, least = (begin + shift + b, begin + shift + e, matched), matched + 1
    return best


SCHEMA = "doc_id long, item_id long, first_token int, end_token int, matched int, item_share double"


def portions(benchmark: DataFrame) -> list[DataFrame]:
    """The items in portions whose texts have some PORTION_BYTES each."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = 1 + int(size) // PORTION_BYTES
    return [items.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k) for k in range(n)]


def _shared_portions(docs: DataFrame, benchmark: DataFrame) -> Iterator:
    """A broadcast of each portion of the benchmark; a portion is bounded by PORTION_BYTES."""
    for items in portions(benchmark):
        held = sorted((tuple(r) for r in items.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        yield docs.sparkSession.sparkContext.broadcast(Benchmark.of([-1 if i is None else i for i, _ in held], [t for _, t in held]))


def overlapping(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item that overlap: the stretch of the document's tokens, how many are equal, and their share of the item."""
    rows, out = id_and_text(docs), None
    for shared in _shared_portions(docs, benchmark):
        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = shared.value
            length = dict(zip(held.item_ids.tolist(), np.diff(held.offsets).tolist()))
            for part in text_parts(batches):
                found = held.overlaps(part.column("text"))
                ids = part.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
                columns = list(zip(*found)) if found else [()] * 5
                share = [m / max(1, length[i]) for _, i, _, _, m in found]
                yield pa.RecordBatch.from_arrays([ids, pa.array(columns[1], pa.int64()), *(pa.array(c, pa.int32()) for c in columns[2:]), pa.array(share, pa.float64())], names=["doc_id", "item_id", "first_token", "end_token", "matched", "item_share"])

        found = rows.mapInArrow(find, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any overlap, with all their columns: a filter for each portion of the benchmark, without a join."""
    for shared in _shared_portions(docs, benchmark):
        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part in text_parts(batches):
                clean = np.ones(part.num_rows, bool)
                clean[[f[0] for f in shared.value.overlaps(part.column("text"))]] = False
                yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
