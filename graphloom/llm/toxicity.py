"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney bigram models, one of the documents labelled toxic
and one of the others. With n, t and c counting tokens, types and continuations,
of a class or (s) of both:

    P(w | u)  = (max(n(u, w) - 1, 0) + t(u) Q(w | u)) / n(u)
    Q(w | u)  = P_s(w | u) P(w) / P_s(w)          the shared bigram, tilted by the class's words
    P(w)      = (max(c(w) - 1, 0) + types P_s(w)) / c
    P_s(w | u), P_s(w): the same from the counts of both classes

So rare expressions take their probability from shared backoff counts. The
discount is 1, the most that absolute discounting takes: a pair that no class
has seen twice says nothing of its own, its log-likelihood ratio is
b(u) + g(w), and only pairs that a class has seen at least twice are kept.

A text is compared by the difference of its length-normalised log-likelihoods,
and by how far single words' ratios exceed fixed ones, with the length: a few
toxic words in a long ordinary text hardly move the mean (the README has
figures). A logistic calibration on labelled rows that the counts have not seen
makes a score of it.

Scale: every labelled text outside the calibration fold is counted, by 64-bit
hashes of words. A task ships its distinct pairs as packed sorted arrays, dealt
by context; what reducers write are tables of words and of pairs that grow with
the corpus. Scoring reads each text once, without a shuffle; the tables are
broadcast in portions of PORTION entries, and a task that meets more than
KEPT_PORTIONS of them goes through them one at a time, so its memory is bounded
whatever the corpus.

Defined cases: null and empty texts score what no evidence scores; a null or
unknown label does not count; several labels of one doc_id count as toxic if
one is; without labelled rows of both classes every score is 0; an empty
table gives an empty result; repeated rows score alike; extra columns, lang
and source are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import discard, hash_sample, hash_strings, id_and_text, mix, row_sums, split_words, text_parts, with_labels, written

#: What continuation counts of both classes are discounted by.
SHARED_DISCOUNT = 0.75
#: Log ratios beyond which a word's excess counts.
EXCESS = (0.5, 1.0, 2.0, 3.0, 4.0)
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 4
#: Labelled rows that the calibration uses at most, about.
CALIBRATION_ROWS = 20_000
#: Distinct pairs that a task holds before it ships them; bytes of labelled text for a segment of pairs, and the fewest segments.
FLUSH_PAIRS, SEGMENT_BYTES, LEAST_SEGMENTS = 500_000, 4 << 20, 64
#: Entries of a portion of the model (some 12 bytes each), portions that a worker keeps, and tokens that it holds while it goes through more.
PORTION, KEPT_PORTIONS, HELD_TOKENS = 500_000, 6, 1_000_000
EDGES = ".,;:!?|#$%&*\"'()[]{}<>«»„“”‘’…-_/\\=+~^`"
START = np.uint64(0x5354415254)
ODD = np.uint64(0x9E3779B97F4A7C15)


def fold(doc_id: Column) -> Column:
    """crc32 of the decimal doc_id, modulo 5."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(FOLDS)).cast("int")


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets by row, and each word's hash and its predecessor's. Words are lower-cased, without punctuation at their edges."""
    offsets, codes, words = split_words(texts)
    hashes = hash_strings([w.lower().strip(EDGES) for w in words.to_pylist()])[codes]
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[offsets[:-1][np.diff(offsets) > 0]] = START
    return offsets, hashes, before


def pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(before * ODD + words)


def merged(before: np.ndarray, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, sorted by context and word, with the sums of their counts by class."""
    order = np.lexsort((words, before))
    before, words, counts = before[order], words[order], counts[order]
    if not len(order):
        return before, words, counts
    first = np.flatnonzero(np.concatenate([[True], (before[1:] != before[:-1]) | (words[1:] != words[:-1])]))
    return before[first], words[first], np.add.reduceat(counts, first, axis=0)


def packed(before: np.ndarray, words: np.ndarray, counts: np.ndarray, segments: int) -> Iterator[dict]:
    """Sorted distinct pairs dealt to segments by context."""
    segment = (mix(before + np.uint64(7)) % np.uint64(segments)).astype(np.int64)
    order = np.argsort(segment, kind="stable")
    begins = np.flatnonzero(np.concatenate([[True], np.diff(segment[order]) > 0])) if len(order) else order
    for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(order)]):
        pick = order[begin:end]
        planes = [np.diff(before[pick], prepend=np.uint64(0)), words[pick], np.ascontiguousarray(counts[pick].astype(np.uint32)).view(np.uint64).ravel()]
        data = b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes() for x in planes)
        yield {"segment": int(segment[order[begin]]), "n": len(pick), "data": zlib.compress(data, 1)}


def unpacked(n: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(3, 8, n)
    steps, words, counts = (np.ascontiguousarray(p.T).view(np.uint64).ravel() for p in planes)
    return np.cumsum(steps, dtype=np.uint64), words, counts.view(np.uint32).reshape(n, 2).astype(np.int64)


def gather_pairs(segments: int, flush: int):
    """(text, toxic) rows to packed (context, word) pairs with their counts by class."""
    schema = pa.schema([("segment", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0

        def ship():
            out = pa.RecordBatch.from_pylist(list(packed(*merged(*(np.concatenate(c) for c in zip(*held))), segments)), schema=schema)
            held.clear()
            return out

        for part in text_parts(batches):
            offsets, words, before = word_hashes(part.column("text"))
            toxic = np.repeat(np.asarray(part.column("toxic"), dtype=np.int64), np.diff(offsets))
            held.append(merged(before, words, np.stack([1 - toxic, toxic], axis=1)))
            n += len(held[-1][0])
            if n > flush:
                yield ship()
                n = 0
        if held:
            yield ship()

    return run


#: Kinds of counted rows: (context; tokens by class, types by class and of both), (word; continuations by class and of both), (context, word; tokens by class, key).
CONTEXT, WORD, PAIR = range(3)
COUNTED = "kind int, a long, b long, " + ", ".join(f"x{k} long" for k in range(5))
COUNTED_SCHEMA = pa.schema([("kind", pa.int32())] + [(c, pa.int64()) for c in ("a", "b", "x0", "x1", "x2", "x3", "x4")])


def _counted(kind: int, a: np.ndarray, b: np.ndarray | None, *x: np.ndarray) -> pa.RecordBatch:
    none = np.zeros(len(a), np.int64)
    columns = [a, none if b is None else b, *x, *[none] * (5 - len(x))]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns)], schema=COUNTED_SCHEMA)


def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed pairs, a segment's rows together, to COUNTED rows: whole contexts, a segment's share of continuations, and pairs that a class has seen twice."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def settle():
        before, words, n = merged(*(np.concatenate(c) for c in zip(*held)))
        held.clear()
        seen = np.column_stack([n, n > 0, np.ones(len(n), np.int64)]).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        yield _counted(CONTEXT, before[first], None, *np.add.reduceat(seen, first, axis=0).T)
        order = np.argsort(words, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], words[order][1:] != words[order][:-1]]))
        yield _counted(WORD, words[order][first], None, *np.add.reduceat(seen[order, 2:], first, axis=0).T)
        more = n.max(axis=1) > 1
        yield _counted(PAIR, before[more], words[more], n[more, 0], n[more, 1], pair_keys(before[more], words[more]))

    last = None
    for batch in batches:
        for segment, n, data in zip(*(batch.column(c).to_pylist() for c in ("segment", "n", "data"))):
            if held and segment != last:
                yield from settle()
            last = segment
            held.append(unpacked(n, data))
    if held:
        yield from settle()


def count_corpus(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word; n0, n1, t0, t1, ts, c0, c1, cs) and (u, w, key, n0, n1) over all labelled rows (text, toxic)."""
    size = labelled.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    segments = max(LEAST_SEGMENTS, int(size) // SEGMENT_BYTES)
    shipped = labelled.select("text", "toxic").mapInArrow(gather_pairs(segments, FLUSH_PAIRS), "segment int, n int, data binary")
    counted = written(shipped.repartition("segment").sortWithinPartitions("segment").mapInArrow(count_pairs, COUNTED), "tox-counted")
    total = lambda kind, x, name: F.sum(F.when(F.col("kind") == kind, F.col(x)).otherwise(0)).alias(name)
    names = [*((CONTEXT, f"x{k}", n) for k, n in enumerate(("n0", "n1", "t0", "t1", "ts"))), *((WORD, f"x{k}", n) for k, n in enumerate(("c0", "c1", "cs")))]
    words = counted.filter(F.col("kind") != PAIR).groupBy(F.col("a").alias("word")).agg(*[total(*n) for n in names])
    pairs = counted.filter(F.col("kind") == PAIR).select(F.col("a").alias("u"), F.col("b").alias("w"), F.col("x2").alias("key"), F.col("x0").alias("n0"), F.col("x1").alias("n1"))
    return written(words, "tox-words"), pairs


def ratios(words: DataFrame, pairs: DataFrame) -> tuple[DataFrame, float]:
    """(kind, key, first, second): b and g of every word, the log ratio of every kept pair; and g of unknown words. Nothing where a class has no words."""
    t = words.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("c0", "c1", "cs")], *[F.count(F.when(F.col(c) > 0, 1)).alias(f"{c}_types") for c in ("c0", "c1", "cs")]).first()
    if not t["c0"] or not t["c1"]:
        return words.select(F.lit(WORD).alias("kind"), F.col("word").alias("key"), F.lit(0.0).alias("first"), F.lit(0.0).alias("second")).limit(0), 0.0
    share = SHARED_DISCOUNT * t["cs_types"] / t["cs"]
    base = F.greatest(F.col("cs") - SHARED_DISCOUNT, F.lit(0)) / t["cs"] + share / (t["cs_types"] + 1)
    mass = [t[f"c{c}_types"] / t[f"c{c}"] for c in (0, 1)]
    unigram = [F.greatest(F.col(f"c{c}") - 1, F.lit(0)) / t[f"c{c}"] + mass[c] * F.col("base") for c in (0, 1)]
    left = [F.when(F.col(f"n{c}") > 0, F.log(F.col(f"t{c}") / F.col(f"n{c}"))).otherwise(0.0) for c in (0, 1)]
    known = words.withColumn("base", base).withColumn("p0", unigram[0]).withColumn("p1", unigram[1])
    by_word = known.select(F.lit(WORD).alias("kind"), F.col("word").alias("key"), (left[1] - left[0]).alias("first"), F.log(F.col("p1") / F.col("p0")).alias("second"))
    context = words.select(F.col("word").alias("u"), *[F.col(c).alias(f"u_{c}") for c in ("n0", "n1", "t0", "t1", "ts")])
    both = pairs.join(context, "u").join(known.select(F.col("word").alias("w"), "base", "p0", "p1"), "w")
    shared = (F.col("n0") + F.col("n1") - 1 + F.col("u_ts") * F.col("base")) / (F.col("u_n0") + F.col("u_n1"))
    tilted = [shared * F.col(f"p{c}") / F.col("base") for c in (0, 1)]
    p = [F.when(F.col(f"u_n{c}") > 0, (F.greatest(F.col(f"n{c}") - 1, F.lit(0)) + F.col(f"u_t{c}") * tilted[c]) / F.col(f"u_n{c}")).otherwise(tilted[c]) for c in (0, 1)]
    by_pair = both.select(F.lit(PAIR).alias("kind"), "key", F.log(p[1] / p[0]).alias("first"), F.lit(0.0).alias("second"))
    return by_word.unionByName(by_pair), float(np.log(mass[1] / mass[0]))


def pack_portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of portions, a portion's together, to one row for each: sorted keys and their values."""
    schema = pa.schema([("kind", pa.int32()), ("keys", pa.binary()), ("numbers", pa.binary())])
    at, held = None, []

    def pack() -> pa.RecordBatch:
        keys = np.concatenate([h[0] for h in held])
        values = np.concatenate([h[1] for h in held])
        order = np.argsort(keys)
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([keys[order].tobytes()]), pa.array([values[order].tobytes()])], schema=schema)

    for batch in batches:
        places = list(zip(batch.column("kind").to_pylist(), batch.column("portion").to_pylist()))
        keys = np.asarray(batch.column("key")).view(np.uint64)
        values = np.stack([np.asarray(batch.column(c), dtype=np.float32) for c in ("first", "second")], axis=1)
        begins = [k for k in range(len(places)) if k == 0 or places[k] != places[k - 1]]
        for begin, end in zip(begins, [*begins[1:], len(places)]):
            if held and places[begin] != at:
                yield pack()
                held = []
            at = places[begin]
            held.append((keys[begin:end], values[begin:end] if at[0] == WORD else values[begin:end, :1]))
    if held:
        yield pack()


@dataclass
class Counts:
    """The broadcast portions of the model: (sorted keys, values) of words and of pairs; what unknown words say."""

    words: list
    pairs: list
    unknown: float

    @classmethod
    def of(cls, labelled: DataFrame) -> Counts:
        """Portions go through the driver one at a time."""
        words, pairs = count_corpus(labelled)
        table, unknown = ratios(words, pairs)
        table = written(table, "tox-model")
        sizes = {r["kind"]: r["count"] for r in table.groupBy("kind").count().collect()}
        n = F.when(F.col("kind") == WORD, -(-sizes.get(WORD, 0) // PORTION)).otherwise(-(-sizes.get(PAIR, 0) // PORTION))
        dealt = table.withColumn("portion", F.pmod(F.xxhash64("key"), F.greatest(n, F.lit(1)))).repartition("kind", "portion").sortWithinPartitions("kind", "portion")
        out = cls([], [], unknown)
        blobs = written(dealt.mapInArrow(pack_portions, "kind int, keys binary, numbers binary"), "tox-portions")
        context = labelled.sparkSession.sparkContext
        for r in blobs.toLocalIterator():
            keys = np.frombuffer(r["keys"], np.uint64)
            (out.words if r["kind"] == WORD else out.pairs).append(context.broadcast((keys, np.frombuffer(r["numbers"], np.float32).reshape(len(keys), -1))))
            del r, keys
        discard(words, table, blobs)
        return out

    def portions(self, kind: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """One portion in memory at a time, unless there are few."""
        few = len(self.words) + len(self.pairs) <= KEPT_PORTIONS
        for shared in self.words if kind == WORD else self.pairs:
            yield shared.value
            if not few and hasattr(shared, "_value"):
                del shared._value


def looked_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys the table has, and their values."""
    at = np.searchsorted(table[0], keys)
    at[at == len(table[0])] = 0
    hit = np.flatnonzero(table[0][at] == keys) if len(table[0]) else np.zeros(0, np.int64)
    return hit, table[1][at[hit]]


def log_ratios(counts: Counts, words: np.ndarray, before: np.ndarray) -> np.ndarray:
    """log P(word | predecessor, toxic) - log P(word | predecessor, other) of each word."""
    distinct, where = np.unique(np.concatenate([words, before]), return_inverse=True)
    b, g = np.zeros(len(distinct)), np.full(len(distinct), counts.unknown)
    for table in counts.portions(WORD):
        hit, found = looked_up(table, distinct)
        b[hit], g[hit] = found[:, 0], found[:, 1]
    out = b[where[len(words) :]] + g[where[: len(words)]]
    keys, where = np.unique(pair_keys(before, words), return_inverse=True)  # sorted, so that a look-up walks through a table
    own = np.full(len(keys), np.nan)
    for table in counts.portions(PAIR):
        hit, found = looked_up(table, keys)
        own[hit] = found[:, 0]
    own = own[where]
    return np.where(np.isnan(own), out, own)


def features(ratio: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """By text: the difference of length-normalised log-likelihoods, and the logarithms of the length and of the excesses, so that weights can normalise these by length too."""
    length = np.diff(offsets)
    out = [row_sums(ratio, offsets) / np.maximum(length, 1), np.log1p(length)]
    out += [np.log1p(np.maximum(row_sums(np.maximum(ratio - x, 0), offsets), 0)) for x in EXCESS]
    return np.stack(out, axis=1)


def featured(counts: Counts, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each slice of the rows, without its text, with the features of its texts."""
    held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]] = []
    most = 0 if len(counts.words) + len(counts.pairs) <= KEPT_PORTIONS else HELD_TOKENS

    def finish():
        ratio = log_ratios(counts, *(np.concatenate([h[k] for h in held]) for k in (2, 3)))
        at = 0
        for rest, offsets, words, _ in held:
            yield rest, features(ratio[at : at + len(words)], offsets)
            at += len(words)
        held.clear()

    for part in text_parts(batches):
        offsets, words, before = word_hashes(part.column("text"))
        held.append((part.drop_columns(["text"]), offsets, words, before))
        if sum(len(h[2]) for h in held) >= most:
            yield from finish()
    if held:
        yield from finish()


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights (last: intercept) on standardised columns, folded back to raw ones; Newton steps."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.diag([ridge * len(x)] * x.shape[1] + [1e-9])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    raw = w[:-1] / scale
    return np.concatenate([raw, [w[-1] - raw @ mean]])


def predict(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))


@dataclass
class ToxicityModel:
    counts: Counts | None
    weights: np.ndarray | None


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """The model from documents and labels (doc_id, toxic 0 or 1); rows of the held-out fold are not used."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != HELD_OUT)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = id_and_text(docs)
    counts = Counts.of(with_labels(rows, known.filter(fold(F.col("doc_id")) != CALIBRATION)))
    sample = with_labels(rows, hash_sample(known.filter(fold(F.col("doc_id")) == CALIBRATION), CALIBRATION_ROWS))
    if not counts.words:
        return ToxicityModel(None, None)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rest, x in featured(counts, batches):
            yield pa.RecordBatch.from_arrays([rest.column("doc_id"), rest.column("toxic"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["doc_id", "toxic", "x"])

    got = sorted(sample.select("doc_id", "toxic", "text").mapInArrow(judged, "doc_id long, toxic int, x array<double>").collect(), key=lambda r: (r["doc_id"], r["x"]))  # bounded by CALIBRATION_ROWS
    y = np.asarray([r["toxic"] for r in got], dtype=np.float64)
    if len(y) < 4 or y.min() == y.max():
        return ToxicityModel(None, None)
    return ToxicityModel(counts, fit_logistic(np.asarray([r["x"] for r in got]), y))


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score (0 to 1, higher: likelier toxic) of every whole text; no shuffle."""
    if model.weights is None:
        return id_and_text(docs).select("doc_id", F.lit(0.0).alias("score"))
    counts, weights = model.counts, model.weights

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rest, x in featured(counts, batches):
            yield pa.RecordBatch.from_arrays([rest.column("doc_id"), pa.array(predict(weights, x), pa.float64())], names=["doc_id", "score"])

    return id_and_text(docs).mapInArrow(score, "doc_id long, score double")


def scored_with_folds(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score_documents(docs, train(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
