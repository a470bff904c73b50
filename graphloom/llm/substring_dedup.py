"""Substring deduplication with longest-previous-factor arrays.

A byte goes if a string of WINDOW bytes that covers it also starts in a
document with a smaller doc_id; matches never cross documents. Strings are
judged on the input, so the first document that has a string keeps it.

A suffix array of the whole corpus would be one object of the corpus' size.
It is cut by content instead: every window of WINDOW bytes belongs to the
smallest hash of the GRAM-byte strings in it, its anchor, so equal windows have
equal anchors wherever they are. Windows in a row with one anchor make a
stretch. Longest-previous-factor arrays decide every window, first over
stretches by name, then over bytes:

1. A stretch is named by (anchor, hash of its content). Sorted by name, each has
   the whole stretch in common with the one before it, or nothing; where the
   previous or next smaller position (by document) shares the name, the longest
   previous factor is the stretch and all its windows go. Each task does this to
   what it reads, some FLUSH_STRETCHES at a time, and ships the others as packed
   columns (hashes, not text), dealt by anchor.
2. The same for each anchor over all tasks. What is left are anchors whose
   stretches differ: the edges of repeated passages, where a window may match
   although the stretch does not.
3. The text of those stretches only is fetched, and the suffixes of each
   anchor's stretches are sorted to WINDOW bytes. The previous and next smaller
   positions in suffix order give each suffix its longest factor in an earlier
   document; where it reaches WINDOW, the window is a span.
4. The spans of a document are merged and cut from its bytes.

Common anchors (a phrase that a third of all documents have) are split: a task
that meets more than LOCAL_CONTENTS different stretches of one anchor sends
them straight to step 3, with word to the others that the anchor is common;
there an anchor with more than WHOLE_STRETCHES is dealt by the hash of its
windows, after each task has reduced equal windows to those of the first
document. Segments grow in number with the input, so no task holds more than
some SEGMENT_BYTES of text, whatever its size.

Names are 128 bits: 64 of the anchor, 64 of the content. Step 3 compares bytes.

Defined cases: null text counts as empty; a null doc_id counts as larger than
any other; rows that share a doc_id never remove from each other; texts under
WINDOW bytes keep everything; an empty table gives an empty result; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import broadcastable, id_and_text, join_groups, mix, text_parts, with_labels, without_labels, written

WINDOW, GRAM = 50, 20
LONGEST_RUN = 48
#: Bytes hashed at a time; longer texts are read in chunks that overlap by a window.
CHUNK = 256 << 10
#: Stretches that a task sorts at a time before it ships them.
FLUSH_STRETCHES = 250_000
#: Bytes of text whose stretches make a segment, about, and the fewest segments.
SEGMENT_BYTES, LEAST_SEGMENTS = 8 << 20, 256
#: Different stretches of an anchor in one flush beyond which it is common.
LOCAL_CONTENTS = 64
#: Stretches of an anchor that are sorted whole; more are dealt by window, to a bucket for each so many.
WHOLE_STRETCHES, BUCKET_STRETCHES = 1_000, 200
#: Stretches whose suffixes are sorted at a time, about.
SORTED_STRETCHES = 10_000
#: Bytes of text whose stretches are cut at a time.
CUT_BYTES = 1 << 20
NO_ID = (1 << 63) - 1
MULTIPLY = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * MULTIPLY[0])


def doc_keys(docs: DataFrame) -> DataFrame:
    """(order, print, text): the rank of the document, and with it a key that any run computes alike."""
    order = F.coalesce(F.col("doc_id"), F.lit(NO_ID))
    return id_and_text(docs).select("doc_id", order.alias("order"), F.xxhash64("text").alias("print"), "text")


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins."""
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def window_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each GRAM-byte string and of each window, by start."""
    h = BYTE_HASH[data]
    powers = {1: h}
    for k, width in enumerate((1, 2, 4, 8, 16)):
        h = powers[width]
        powers[2 * width] = h[: len(h) - width] * MULTIPLY[k] + h[width:]
    n = len(data)
    gram = mix(powers[16][: n - GRAM + 1] * MULTIPLY[5] + powers[4][16 : 16 + n - GRAM + 1])
    w = n - WINDOW + 1
    window = powers[32][:w] * MULTIPLY[5] + powers[16][32 : 32 + w]
    return gram, mix(window * MULTIPLY[6] + powers[2][48 : 48 + w])


def chunks(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(first row, end row, first byte, end byte): rows of `size` bytes together, or a part of a longer one."""
    row = 0
    while row < len(offsets) - 1:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        if offsets[end] - offsets[row] <= size:
            yield row, end, int(offsets[row]), int(offsets[end])
        else:
            for begin in range(int(offsets[row]), int(offsets[end]) - WINDOW + 1, size):
                yield row, end, begin, min(int(offsets[end]), begin + size + WINDOW - 1)
        row = end


def stretches(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, windows, anchor, content) of the stretches of consecutive texts that end at `ends`, for all windows within one text."""
    if len(data) < WINDOW:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    gram, window = window_hashes(data)
    low, width = gram, 1
    span = WINDOW - GRAM + 1
    while width * 2 <= span:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    low = np.minimum(low[: len(window)], low[span - width : span - width + len(window)])
    new = np.concatenate([[True], low[1:] != low[:-1]])
    new[ends[ends < len(new)]] = True
    first = np.flatnonzero(new)
    run = np.diff(np.concatenate([first, [len(low)]]))
    run = np.minimum(run, ends[np.searchsorted(ends, first, side="right")] - WINDOW + 1 - first)  # windows beyond the text's end do not count
    first, run = first[run > 0], run[run > 0]
    if len(run) and run.max() > LONGEST_RUN:
        parts = -(-run // LONGEST_RUN)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        last = np.repeat(first + run, parts)
        first = np.repeat(first, parts) + nth * LONGEST_RUN
        run = np.minimum(last - first, LONGEST_RUN)
    return first, run, low[first], mix(window[first] * MULTIPLY[1] + window[first + run - 1] * MULTIPLY[2] + run.astype(np.uint64))


STRETCH = np.dtype([("anchor", np.uint64), ("content", np.uint64), ("order", np.int64), ("print", np.int64), ("start", np.int32), ("run", np.int32)])


def text_stretches(part: pa.RecordBatch, chunk: int) -> Iterator[np.ndarray]:
    """The stretches of rows of (order, print, text)."""
    data, offsets = text_bytes(part.column("text"))
    orders, prints = (np.asarray(part.column(c), dtype=np.int64) for c in ("order", "print"))
    for row, end_row, begin, end in chunks(data, offsets, chunk):
        ends = np.minimum(offsets[row + 1 : end_row + 1], end) - begin
        first, run, anchor, content = stretches(data[begin:end], ends)
        owner = row + np.searchsorted(ends, first, side="right")
        out = np.empty(len(first), STRETCH)
        out["anchor"], out["content"], out["order"], out["print"] = anchor, content, orders[owner], prints[owner]
        out["start"], out["run"] = first + begin - offsets[owner], run
        yield out


def longest_previous_factors(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each suffix in suffix order, its longest common prefix with any suffix of a smaller position.

    position: of each suffix, in suffix order; common: its common prefix with
    the suffix before it. The longest one is with the previous or the next
    smaller position in suffix order. All suffixes look for theirs at once: one
    that meets a larger position goes on to where that one has come to, and
    stops where nothing is in common any more.
    """
    out = np.zeros(len(position), np.int64)
    for turned in (False, True):
        p = position[::-1] if turned else position
        held = np.concatenate([[0], common[:0:-1]]) if turned else common.copy()  # in common with the suffix at `at` and all between
        held[:1] = 0
        at = np.arange(len(p)) - 1
        open_ = np.flatnonzero(held > 0)
        open_ = open_[p[at[open_]] >= p[open_]]
        while len(open_):
            via = at[open_]
            held[open_], at[open_] = np.minimum(held[open_], held[via]), at[via]
            open_ = open_[held[open_] > 0]
            open_ = open_[p[at[open_]] >= p[open_]]
        out = np.maximum(out, held[::-1] if turned else held)
    return out


def sorted_stretches(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By name and document; with marks of the first row of each anchor and of each name."""
    rows = rows[np.lexsort((rows["start"], rows["print"], rows["order"], rows["content"], rows["anchor"]))]
    new_anchor = np.concatenate([[True], rows["anchor"][1:] != rows["anchor"][:-1]]) if len(rows) else np.zeros(0, bool)
    new_content = new_anchor.copy()
    new_content[1:] |= rows["content"][1:] != rows["content"][:-1]
    return rows, new_anchor, new_content


def repeated(rows: np.ndarray, new_content: np.ndarray) -> np.ndarray:
    """Which sorted stretches have a longest previous factor: an equal name has the whole stretch in common, another name nothing."""
    same = np.flatnonzero(~new_content | np.append(~new_content[1:], False))  # the others stand alone
    common = np.where(new_content[same], 0, rows["run"][same].astype(np.int64) - 1 + WINDOW)
    out = np.zeros(len(rows), bool)
    out[same] = longest_previous_factors(rows["order"][same], common) >= WINDOW
    return out


def merged_spans(rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """(order, print, start, end): the union of the spans of stretches."""
    rows = rows[np.lexsort((rows["start"], rows["print"], rows["order"]))]
    if not len(rows):
        return rows["order"], rows["print"], rows["start"], rows["start"]
    end = rows["start"].astype(np.int64) + rows["run"] - 1 + WINDOW
    doc = np.cumsum(np.concatenate([[0], (rows["order"][1:] != rows["order"][:-1]) | (rows["print"][1:] != rows["print"][:-1])]))
    lift = doc * np.int64(1 << 40)
    reach = np.maximum.accumulate(end + lift)
    new = np.concatenate([[True], rows["start"][1:] + lift[1:] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(rows) - 1]])
    return rows["order"][new], rows["print"][new], rows["start"][new], (reach - lift)[last].astype(np.int32)


#: What a row of SHIPPED holds: one span; stretches; stretches of common anchors; common anchors.
SPAN, STRETCHES, COMMON_STRETCHES, COMMON = range(4)
SHIPPED = pa.schema([("segment", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("docs", pa.binary()), ("data", pa.binary())])


def planes(values: np.ndarray, width: int) -> bytes:
    """The lowest `width` bytes of each value, all lowest bytes first."""
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1)[:, :width].T).tobytes()


def from_planes(data: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.view(np.uint64).ravel()


def dealt(key: np.ndarray, segments: int) -> Iterator[tuple[int, np.ndarray]]:
    """(segment, rows) for each segment that has any."""
    segment = (mix(key + MULTIPLY[3]) % np.uint64(segments)).astype(np.int64)
    order = np.argsort(segment, kind="stable")
    begins = np.flatnonzero(np.concatenate([[True], np.diff(segment[order]) > 0])) if len(order) else order
    for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(order)]):
        yield int(segment[order[begin]]), order[begin:end]


def packed(rows: np.ndarray, kind: int, segments: int) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    for segment, pick in dealt(rows["anchor"] if kind == STRETCHES else rows["content"], segments):
        r = rows[pick]
        new = np.concatenate([[True], (r["order"][1:] != r["order"][:-1]) | (r["print"][1:] != r["print"][:-1])])
        docs = np.stack([r["order"][new], r["print"][new]], axis=1)
        index = (np.cumsum(new) - 1).astype(np.uint32)
        data = planes(np.diff(r["anchor"], prepend=np.uint64(0)), 8) + planes(r["content"], 8) + planes(index, 4) + planes(r["start"].astype(np.uint32), 4) + planes(r["run"].astype(np.uint8), 1)
        yield segment, kind, len(r), docs.tobytes(), data


def unpacked(n: int, docs: bytes, data: bytes) -> np.ndarray:
    out, view, at = np.empty(n, STRETCH), memoryview(data), 0
    columns = []
    for width in (8, 8, 4, 4, 1):
        columns.append(from_planes(view[at : at + width * n], n, width))
        at += width * n
    keys = np.frombuffer(docs, np.int64).reshape(-1, 2)[columns[2].astype(np.int64)]
    out["anchor"], out["content"], out["order"], out["print"] = np.cumsum(columns[0], dtype=np.uint64), columns[1], keys[:, 0], keys[:, 1]
    out["start"], out["run"] = columns[3].astype(np.int32), columns[4].astype(np.int32)
    return out


def ship_stretches(segments: int, chunk: int, flush: int, local_contents: int):
    """Step 1."""
    def ship(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows, new_anchor, new_content = sorted_stretches(np.concatenate(held))
        held.clear()
        late = repeated(rows, new_content)
        group = np.cumsum(new_anchor) - 1
        common = (np.bincount(group, new_content) > local_contents)[group] if len(rows) else late
        out = [(int(o % segments), SPAN, 1, np.array([o, p], np.int64).tobytes(), np.array([s, e], np.int32).tobytes()) for o, p, s, e in zip(*(x.tolist() for x in merged_spans(rows[late])))]
        out += packed(rows[~late & ~common], STRETCHES, segments)
        out += packed(rows[~late & common], COMMON_STRETCHES, segments)
        anchors = rows["anchor"][new_anchor & common]
        out += [(segment, COMMON, len(pick), b"", anchors[pick].tobytes()) for segment, pick in dealt(anchors, segments)]
        del rows
        for k in range(0, len(out), 2_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[k : k + 2_000]), SHIPPED)], schema=SHIPPED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for part in text_parts(batches):
            for rows in text_stretches(part, chunk):
                held.append(rows)
                n += len(rows)
                if n > flush:
                    yield from ship(held)
                    n = 0
        if held:
            yield from ship(held)

    return run


FOUND = "order long, print long, start int, end int, anchor long, mixed boolean"
FOUND_SCHEMA = pa.schema([("order", pa.int64()), ("print", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("anchor", pa.int64()), ("mixed", pa.bool_())])


def _found_mixed(r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(r["order"].copy()), pa.array(r["print"].copy()), pa.array(r["start"].copy()), pa.array((r["start"] + r["run"] - 1 + WINDOW).astype(np.int32)), pa.array(r["anchor"].copy().view(np.int64)), pa.array(np.ones(len(r), bool))], schema=FOUND_SCHEMA)


def _found_spans(order, prints, start, end) -> pa.RecordBatch:
    n = len(order)
    return pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), pa.array(prints, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n, bool))], schema=FOUND_SCHEMA)


def settle_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2, a segment's rows together: spans, and the stretches of anchors with several contents."""
    last, held, common = None, [], []

    def settle():
        if held:
            rows, new_anchor, new_content = sorted_stretches(np.concatenate(held))
            late = repeated(rows, new_content)
            group = np.cumsum(new_anchor) - 1
            mixed = (np.bincount(group, new_content) > 1)[group]
            if common:
                mixed |= np.isin(rows["anchor"], np.concatenate(common))
            yield _found_spans(*merged_spans(rows[late]))
            yield _found_mixed(rows[mixed & ~late])
        held.clear()
        common.clear()

    for batch in batches:
        spans: list[tuple[int, int, int, int]] = []
        for segment, kind, n, docs, data in zip(*(batch.column(c).to_pylist() for c in ("segment", "kind", "n", "docs", "data"))):
            if kind == SPAN:
                spans.append((*np.frombuffer(docs, np.int64).tolist(), *np.frombuffer(data, np.int32).tolist()))
                continue
            if kind == COMMON_STRETCHES:
                yield _found_mixed(unpacked(n, docs, data))
                continue
            if segment != last:
                yield from settle()
            last = segment
            if kind == COMMON:
                common.append(np.frombuffer(data, np.uint64))
            else:
                held.append(unpacked(n, docs, data))
        if spans:
            yield _found_spans(*zip(*spans))
    yield from settle()


def suffix_order(data: np.ndarray, starts: np.ndarray, depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes of data at `starts` by their first `depth` bytes (all there), and each one's common prefix with the one before it."""
    keys = []
    for at in range(0, depth, 8):
        word = np.zeros(len(starts), np.uint64)
        for b in range(at, min(at + 8, depth)):
            word |= data[starts + b].astype(np.uint64) << np.uint64(8 * (7 - (b - at)))
        keys.append(word)
    order = np.lexsort(keys[::-1])
    common = np.zeros(len(starts), np.int64)
    going = np.ones(max(len(starts) - 1, 0), bool)
    for k, word in enumerate(keys):
        w = word[order]
        differ = w[1:] ^ w[:-1]
        zero = differ == 0
        top = np.zeros(len(differ), np.int64)
        for shift in (32, 16, 8):  # leading equal bytes
            high = (differ >> np.uint64(64 - shift)) == 0
            top += np.where(high, shift // 8, 0)
            differ = np.where(high, differ << np.uint64(shift), differ)
        width = min(8, depth - 8 * k)
        common[1:] += np.where(going, np.where(zero, width, np.minimum(top, width)), 0)
        going &= zero
    return order, common


def repeated_windows(texts: list[bytes], orders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, offset) of every window that also starts in a stretch of an earlier document. Equal windows have equal anchors, so the stretches of one anchor only meet each other."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    begin = np.cumsum(size) - size
    n = size - WINDOW + 1
    owner = np.repeat(np.arange(len(texts)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    order, common = suffix_order(data, begin[owner] + offset)
    full = common >= WINDOW
    near = full | np.concatenate([full[1:], [False]])  # others have no factor of WINDOW bytes on either side
    kept = order[near]
    hit = kept[longest_previous_factors(orders[owner[kept]], np.where(full, common, 0)[near]) >= WINDOW]
    return owner[hit], offset[hit]


PLACED = pa.schema([("anchor", pa.int64()), ("bucket", pa.int32()), ("order", pa.int64()), ("print", pa.int64()), ("starts", pa.list_(pa.int32())), ("context", pa.binary())])
SPANS = "order long, print long, start int, end int"


def edge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3, the rows of an anchor's bucket together: (order, print, start, end) of repeated windows."""
    schema = pa.schema(list(FOUND_SCHEMA)[:4])

    def solve(held: list[tuple]) -> pa.RecordBatch:
        _, orders, prints, starts, texts = zip(*held)
        owner, offset = repeated_windows(list(texts), np.array(orders, np.int64))
        times = np.array([len(x) for x in starts])[owner]
        rows = np.empty(int(times.sum()), STRETCH)
        again = np.repeat(owner, times)
        rows["order"], rows["print"], rows["run"] = np.array(orders, np.int64)[again], np.array(prints, np.int64)[again], 1
        rows["start"] = np.array([s for k in owner.tolist() for s in starts[k]], np.int64) + np.repeat(offset, times)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in merged_spans(rows)], schema=schema)

    held: list[tuple] = []
    for batch in batches:
        keys = zip(batch.column("anchor").to_pylist(), batch.column("bucket").to_pylist())
        for row in zip(keys, *(batch.column(c).to_pylist() for c in ("order", "print", "starts", "context"))):
            if len(held) >= SORTED_STRETCHES and row[0] != held[-1][0]:
                yield solve(held)
                held = []
            held.append(row)
    if held:
        yield solve(held)


class Windows:
    """The windows of common anchors in some texts: equal ones are kept for the first document only, the others are spans, merged by document."""

    def __init__(self):
        self.first: dict[tuple[int, int, bytes], tuple[int, dict[int, list[int]]]] = {}
        self.spans: list[tuple[int, int, int]] = []

    def add(self, anchor: int, bucket: int, order: int, mark: int, start: int, window: bytes) -> None:
        key = (anchor, bucket, window)
        held = self.first.get(key)
        if held is None or order < held[0]:
            if held:
                self.spans += [(held[0], m, s) for m, starts in held[1].items() for s in starts]
            self.first[key] = (order, {mark: [start]})
        elif order == held[0]:
            held[1].setdefault(mark, []).append(start)
        else:
            self.spans.append((order, mark, start))

    def rows(self) -> list[tuple]:
        kept = [(anchor, bucket, order, mark, starts, window) for (anchor, bucket, window), (order, marks) in self.first.items() for mark, starts in marks.items()]
        spans = np.zeros(len(self.spans), STRETCH)
        if self.spans:
            spans["order"], spans["print"], spans["start"] = np.array(self.spans, np.int64).T
        spans["run"] = 1
        return kept + [(0, -1, order, mark, [start, end], b"") for order, mark, start, end in zip(*(x.tolist() for x in merged_spans(spans)))]


def contexts(mixed: DataFrame, keyed: DataFrame) -> DataFrame:
    """PLACED rows: the bytes of stretches, or of single windows for common anchors (bucket -1: the start and end of a span of windows that are settled already). Texts are fetched for their documents only, and shuffled once."""
    sizes = written(mixed.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")), "sub-sizes")
    buckets = F.when(F.col("n") > WHOLE_STRETCHES, F.ceil(F.col("n") / BUCKET_STRETCHES)).otherwise(F.lit(0)).cast("int")
    if sizes.filter(F.col("n") > WHOLE_STRETCHES).limit(1).count():
        mixed = join_groups(mixed, sizes, ["anchor"], "n")
    else:
        mixed = mixed.withColumn("n", F.lit(1))
    places = written(mixed.groupBy("order", "print").agg(F.collect_list(F.struct("anchor", "start", "end", buckets.alias("buckets"))).alias("places")), "sub-places")
    texts, ids = keyed.select("order", "print", "text"), places.select("order").distinct()
    if broadcastable(ids):  # else a join by id would be a shuffle of all texts before the next one
        texts = texts.join(F.broadcast(ids), "order")
    both = texts.dropDuplicates(["order", "print"]).join(places, ["order", "print"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_parts(batches, most=CUT_BYTES):
            out: list[tuple] = []
            windows = Windows()
            for order, mark, text, where in zip(*(part.column(c).to_pylist() for c in ("order", "print", "text", "places"))):
                data = text.encode()
                for p in where:
                    if not p["buckets"]:
                        out.append((p["anchor"], 0, order, mark, [p["start"]], data[p["start"] : p["end"]]))
                        continue
                    for start in range(p["start"], p["end"] - WINDOW + 1):
                        window = data[start : start + WINDOW]
                        windows.add(p["anchor"], zlib.crc32(window) % p["buckets"], order, mark, start, window)
            out += windows.rows()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * len(PLACED), PLACED)], schema=PLACED)

    return both.mapInArrow(cut, "anchor long, bucket int, order long, print long, starts array<int>, context binary")


def repeated_spans(keyed: DataFrame) -> DataFrame:
    """(order, print, start, end) of spans to remove; they may overlap."""
    total = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    segments = max(LEAST_SEGMENTS, int(total) // SEGMENT_BYTES)
    shipped = keyed.select("order", "print", "text").mapInArrow(ship_stretches(segments, CHUNK, FLUSH_STRETCHES, LOCAL_CONTENTS), "segment int, kind int, n int, docs binary, data binary")
    found = written(shipped.repartition("segment").sortWithinPartitions("segment").mapInArrow(settle_stretches, FOUND), "sub-found")
    placed = written(contexts(found.filter("mixed").drop("mixed"), keyed), "sub-contexts")
    edges = placed.filter("bucket >= 0").repartition("anchor", "bucket").sortWithinPartitions("anchor", "bucket").mapInArrow(edge_spans, SPANS)
    local = placed.filter("bucket < 0").select("order", "print", F.col("starts")[0].alias("start"), F.col("starts")[1].alias("end"))
    return found.filter("NOT mixed").select("order", "print", "start", "end").unionByName(local).unionByName(edges)


def merge_by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans sorted by document and start to one row for each document."""
    schema = pa.schema([("order", pa.int64()), ("print", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])
    key, starts, ends = None, [], []
    for batch in batches:
        out: list[tuple] = []
        for order, mark, start, end in zip(*(batch.column(c).to_pylist() for c in ("order", "print", "start", "end"))):
            if (order, mark) != key:
                if key:
                    out.append((*key, starts, ends))
                key, starts, ends = (order, mark), [start], [end]
            elif start <= ends[-1]:
                ends[-1] = max(ends[-1], end)
            else:
                starts.append(start)
                ends.append(end)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*key, starts, ends), schema)], schema=schema)


def spans_by_document(keyed: DataFrame) -> DataFrame:
    """(order, print, starts, ends): the maximal removed runs of each document that has any."""
    spans = repeated_spans(keyed)
    return written(spans.repartition("order", "print").sortWithinPartitions("order", "print", "start").mapInArrow(merge_by_document, "order long, print long, starts array<int>, ends array<int>"), "sub-spans")


def _with_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text, starts, ends) of every row; null lists where nothing is repeated."""
    keyed = doc_keys(docs)
    spans = spans_by_document(keyed)
    ids = spans.select(F.col("order").alias("doc_id"), F.lit(True).alias("hit")).distinct()
    if not broadcastable(ids):  # one shuffle of the texts, where telling the touched ones apart would be two more
        return keyed.join(spans, ["order", "print"], "left").select("doc_id", "text", "starts", "ends")
    rows = keyed.withColumnRenamed("doc_id", "id").withColumnRenamed("order", "doc_id")
    touched = with_labels(rows, ids).select(F.col("id").alias("doc_id"), F.col("doc_id").alias("order"), "print", "text").join(spans, ["order", "print"], "left").select("doc_id", "text", "starts", "ends")
    whole = without_labels(rows, ids).select(F.col("id").alias("doc_id"), "text", F.lit(None).cast("array<int>").alias("starts"), F.lit(None).cast("array<int>").alias("ends"))
    return whole.unionByName(touched)


def kept_bytes(text: str, starts: list[int] | None, ends: list[int] | None) -> bytes:
    data = text.encode()
    if not starts:
        return data
    bounds = [0, *(x for pair in zip(starts, ends) for x in pair), len(data)]
    return b"".join(data[bounds[k] : bounds[k + 1]] for k in range(0, len(bounds), 2))


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id and the bytes that stay of every document (not always valid UTF-8: a match may begin or end within a character)."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_parts(batches):
            data = [kept_bytes(*r) for r in zip(*(part.column(c).to_pylist() for c in ("text", "starts", "ends")))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return _with_spans(docs).mapInArrow(cut, "doc_id long, data binary")


def removal_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
        for part in text_parts(batches):
            out = []
            for text, starts, ends in zip(*(part.column(c).to_pylist() for c in ("text", "starts", "ends"))):
                kept, n = kept_bytes(text, starts, ends), len(text.encode())
                out.append((n, n - len(kept), len(starts or ()), hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(zip(*out), list(schema)[1:]))], schema=schema)

    return _with_spans(docs).mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


#: The same by brute force over all windows, as hex; for small tables.
ORACLE_SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d WHERE length(h) >= 100)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
g AS MATERIALIZED (SELECT w.doc_id, w.p FROM w JOIN f USING (s) WHERE w.doc_id > f.first),
b AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM g),
n AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS k FROM b),
r AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS z FROM n GROUP BY doc_id, k),
q AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
t AS (SELECT d.doc_id, any_value(length(d.h) // 2) AS n_bytes, coalesce(sum(q.z - q.a), 0) AS n_removed, count(q.a) AS n_spans, coalesce(string_agg(substr(d.h, 2 * q.before + 1, 2 * (q.a - q.before)), '' ORDER BY q.a), '') || substr(any_value(d.h), 2 * coalesce(max(q.z), 0) + 1) AS kept FROM d LEFT JOIN q ON q.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM t
"""
