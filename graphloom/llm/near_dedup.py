"""MinHash near-deduplication with bottom-k sketches of one hash function.

A document's set is its distinct five-word shingles (A-Z lower-cased; words
are runs without ASCII white space; with fewer words, the whole sequence).
Shingles are hashed to 63 bits by one function; the SKETCH smallest hashes are
the sketch. Documents with equal sets form a class, and one member of each
stands for it, so copies cost nothing from there on.

Candidates come from inverted lists of the LISTED smallest retained values. Two
sets at the threshold share LEAST_SHARED of these but for a chance of 3e-10 at
80 percent and 6e-12 at 85, so each class is listed under its rarest values,
all but one less than that: common passages drop out, and a class that shares
fewer values with anyone has no list at all. (This is exact given the overlap.)

1. In each list the member whose values are shared most is the hub, and every
   member meets the hub, never all others. Union sketches tell the near members
   (at most twice the distance allowed, by SLACK standard deviations) from the
   far ones. Jaccard distance is a metric, so a far member has no link with one
   that is linked to the hub.
2. Near members are compared with the hub on the full sets. What is kept of each
   is its delta, the symmetric difference with the hub's set. From then on
   |a & b| = |a & h| + |b & h| - |h| + |delta a & delta b|, so the deltas decide
   every pair of near members exactly: members that missed the hub meet the
   others by their deltas, in blocks of bounded size, and a block returns a
   spanning forest of its links, never its pairs.
3. Far members meet each other, and the near ones that missed the hub, by their
   sketches, in blocks, each pair with the first hub that both have met. A block
   returns hubs that cover its candidate pairs, with the members of each, and
   step 2 settles those.

So every link between different components is found, and no step writes more
rows than a list, or a block, has members (candidates of step 3 that no common
hub covers aside). Links, components, sketches and deltas stay in tables; hot
values, hubs and classes are joined by broadcasting fewer than 2,000 keys.

Defined cases: null and empty texts, and texts of white space, have no
shingles and are linked with nothing; repeated rows and rows that share a
doc_id count as one document, which links as any of its texts does; rows
without a doc_id are linked with nothing and kept; an empty table gives an
empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import discard, drop_ids, hash_strings, id_and_text, join_groups, mix, rolling, split_words, text_parts, with_labels, written

WORDS, SKETCH, SIMILARITY = 5, 128, 80
#: Values that a class may be listed under, and how many of them similar sets share at least.
LISTED, LEAST_SHARED = 16, 4
#: Standard deviations by which an estimate may fall short of what it is held against.
SLACK = 6.0
#: Members of a block, and the values of their deltas, at most, about; columns of a dense step; members that share one reading of their hub.
BLOCK, BLOCK_VALUES, COLUMNS, MEMBERS = 128, 400_000, 8_192, 64


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    offsets, codes, distinct = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    hashes = hash_strings(distinct.to_pylist())[codes]
    windows = rolling(hashes, words) >> np.uint64(1)
    out = []
    for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        n = end - begin
        if n >= words:
            out.append(np.unique(windows[begin : end - words + 1]))
        else:
            out.append(mix(rolling(hashes[begin:end], n) + np.uint64(n)) >> np.uint64(1) if n else np.zeros(0, np.uint64))
    return out


def profiles(docs: DataFrame, sketch: int = SKETCH) -> DataFrame:
    """(doc_id, print, n, key_a, key_b, sketch): a mark of the text, set size, 128 bits that stand for the set, and its smallest hashes."""
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_parts(batches):
            sets = shingle_sets(part.column("text"))
            keys = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
            low = [s[:sketch].view(np.int64) for s in sets]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in low])]), pa.int32()), pa.array(np.concatenate(low)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("print"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), lists], names=["doc_id", "print", "n", "key_a", "key_b", "sketch"])

    return marked_texts(docs).mapInArrow(profile, "doc_id long, print long, n long, key_a long, key_b long, sketch array<long>")


def marked_texts(docs: DataFrame) -> DataFrame:
    return id_and_text(docs).select("doc_id", F.xxhash64("text").alias("print"), "text")


def inverted_lists(reps: DataFrame) -> DataFrame:
    """(value, rep, n, fame): the rarest retained values of each representative that others retain too; fame is how often its values are retained in all."""
    low = F.slice("sketch", 1, LISTED)
    postings = reps.select("rep", "n", F.size(low).alias("kept"), F.explode(low).alias("value"))
    frequent = written(postings.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "near-values")
    shared = join_groups(postings, frequent, ["value"], "df")
    mine = shared.groupBy("rep", "n", "kept").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("values"), F.sum("df").alias("fame"))
    least = F.greatest(F.floor(F.col("kept") * LEAST_SHARED / LISTED), F.lit(1)).cast("int")
    return mine.filter(F.size("values") >= least).select("rep", "n", "fame", F.explode(F.slice("values", F.lit(1), F.size("values") - least + 1)).alias("v")).select(F.col("v.value").alias("value"), "rep", "n", "fame")


def near_hub(stars: DataFrame, reps: DataFrame, similarity: int) -> DataFrame:
    """The (hub, rep) pairs whose distance is not above 2 * (100 - similarity), unless the union sketch is SLACK deviations off."""
    reach = max(0, 2 * similarity - 100)
    near = stars.filter(F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * reach)
    sketches = reps.select("rep", "sketch")
    counted = near.groupBy("hub").agg(F.count(F.lit(1)).alias("pairs"))
    hubs = with_labels(sketches.select(F.col("rep").alias("hub"), F.col("sketch").alias("hub_sketch")), counted, ["hub"])
    both = join_groups(with_labels(sketches, near, ["rep"]), written(hubs, "near-hubs"), ["hub"], "pairs")
    end = lambda c: F.when(F.size(c) >= SKETCH, F.element_at(c, -1)).otherwise(F.lit((1 << 63) - 1))
    both = both.withColumn("limit", F.least(end("sketch"), end("hub_sketch")))
    union = F.size(F.filter(F.array_union("sketch", "hub_sketch"), lambda x: x <= F.col("limit")))
    shared = F.size(F.filter(F.array_intersect("sketch", "hub_sketch"), lambda x: x <= F.col("limit")))
    both = both.select("hub", "rep", "n", "hub_n", union.alias("union"), shared.alias("shared"))
    s = reach / 100
    left_out = F.greatest(F.lit(0.0), 1 - F.col("union") / ((F.col("n") + F.col("hub_n")) / (1 + s)))
    slack = SLACK * F.sqrt(s * (1 - s) / F.col("union") * left_out) + 1 / F.col("union")
    return both.filter(F.col("shared") / F.col("union") >= s - slack).select("hub", "rep")


SETTLED = "hub long, rep long, hub_n long, n long, common long, delta binary"


def settled(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(hub, rep, hub_n, n, common, delta) of (hub, rep) pairs, from the full sets. A hub's members are dealt to portions, each of which reads the hub's text once."""
    pairs = written(pairs, "near-pairs")
    ends = pairs.select(F.col("hub").alias("rep")).union(pairs.select("rep")).distinct()
    places = written(with_labels(classes.select("rep", "doc_id", "print"), ends, ["rep"]), "near-ends")
    texts = with_labels(marked_texts(docs), places, ["doc_id", "print"]).groupBy("rep").agg(F.first("text").alias("text"))
    texts = written(texts, "near-texts")
    counted = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("pairs"))
    portions = F.ceil(F.col("pairs") / MEMBERS).cast("int")
    members = join_groups(pairs, written(counted, "near-counted"), ["hub"], "pairs").select("hub", F.pmod(F.xxhash64("rep"), portions).cast("int").alias("portion"), F.lit(1).alias("place"), "rep")
    hubs = counted.select("hub", F.explode(F.sequence(F.lit(0), portions - 1)).alias("portion"), F.lit(0).alias("place"), F.col("hub").alias("rep"))
    rows = members.unionByName(hubs).join(texts, "rep").select("hub", "portion", "place", "rep", "text").repartition("hub", "portion").sortWithinPartitions("hub", "portion", "place")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros(0, np.uint64)
        schema = pa.schema([(c, pa.int64()) for c in ("hub", "rep", "hub_n", "n", "common")] + [("delta", pa.binary())])
        for part in text_parts(batches):
            out: list[tuple] = []
            for h, place, rep, s in zip(*(part.column(c).to_pylist() for c in ("hub", "place", "rep")), shingle_sets(part.column("text"))):
                if place == 0:
                    hub = s
                    continue
                delta = np.setxor1d(hub, s, assume_unique=True)
                out.append((h, rep, len(hub), len(s), (len(hub) + len(s) - len(delta)) // 2, delta.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * 6, schema)], schema=schema)

    return written(rows.mapInArrow(compare, SETTLED), "near-settled")


def linked(similarity: int):
    return F.col("common") * 100 >= (F.col("n") + F.col("hub_n") - F.col("common")) * similarity


def dealt_blocks(rows: DataFrame, key: str, values) -> DataFrame:
    """rows (key, outside, ...) dealt to (key, block) with a side: each block of a key's outside rows meets itself, the later ones and every block of the other rows. Keys without an outside row, or with one row, have none.

    Side 0 holds the rows of an outside block; in the blocks a:b with a < b the
    rows of both are there, with sides 0 and 1.
    """
    counted = lambda c: (F.count(F.when(c, 1)), F.coalesce(F.sum(F.when(c, values)), F.lit(0)))
    blocks = lambda n, v: F.greatest(F.ceil(n / BLOCK), F.ceil(v / BLOCK_VALUES)).cast("int")
    outs, ins = blocks(*counted(F.col("outside"))), blocks(*counted(~F.col("outside")))
    sizes = rows.groupBy(key).agg(outs.alias("outs"), ins.alias("ins"), F.count(F.lit(1)).alias("members")).filter("outs > 0 AND members > 1")
    placed = join_groups(rows, written(sizes, "near-sizes"), [key], "members")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("outside"), F.col("outs")).otherwise(F.col("ins"))).cast("int"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    block = lambda a, kind, b, side: F.struct(F.concat_ws(":", a, F.lit(kind), b).alias("block"), F.lit(side).alias("side"))
    later = F.filter(upto(F.col("outs")), lambda j: j > F.col("own"))
    alone = F.array(block(F.col("own"), "o", F.col("own"), 0))
    with_others = F.transform(later, lambda j: block(F.col("own"), "o", j, 0))
    after_others = F.transform(upto(F.col("own")), lambda i: block(i, "o", F.col("own"), 1))
    with_inside = F.transform(upto(F.col("ins")), lambda j: block(F.col("own"), "i", j, 0))
    inside = F.transform(upto(F.col("outs")), lambda i: block(i, "i", F.col("own"), 1))
    where = F.when(F.col("outside"), F.concat(alone, with_others, after_others, with_inside)).otherwise(inside)
    dealt = placed.withColumn("b", F.explode(where)).select(key, F.col("b.block").alias("block"), F.col("b.side").alias("side"), *[c for c in rows.columns if c != key])
    return dealt.repartition(key, "block").sortWithinPartitions(key, "block")


PAIR = pa.schema([("hub", pa.int64()), ("rep", pa.int64())])


def by_block(key: str, solve: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]):
    """A function for mapInArrow that gives solve the rows of each block together and returns its pairs."""
    def solved(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = solve(pa.Table.from_batches(held))
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64))], schema=PAIR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            keys = list(zip(batch.column(key).to_pylist(), batch.column("block").to_pylist()))
            begins = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
            for begin, end in zip(begins, [*begins[1:], len(keys)]):
                if held and keys[begin] != at:
                    yield solved(held)
                    held = []
                at = keys[begin]
                held.append(batch.slice(begin, end - begin))
        if held:
            yield solved(held)

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of all pairs of sets."""
    values = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, seen = np.unique(values, return_inverse=True, return_counts=True)
    use = seen[column] > 1
    row, column = row[use], (np.cumsum(seen > 1) - 1)[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        low, high = np.searchsorted(column, [begin, begin + COLUMNS])
        table = np.zeros((len(sets), COLUMNS), np.float32)
        table[row[low:high], column[low:high] - begin] = 1
        out += table @ table.T
    return out


def delta_links(similarity: int):
    """Rows of a block of deltas to links that join what the hub has not: outside members with each other, or with members that are linked to the hub."""
    def solve(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        side, rep, n, common, hub_n = (np.asarray(t.column(c), dtype=np.int64) for c in ("side", "rep", "n", "common", "hub_n"))
        outside = np.asarray(t.column("outside"))
        shared = overlaps([np.frombuffer(d, np.int64) for d in t.column("delta").to_pylist()])
        least = -(-similarity * (n[:, None] + n[None, :]) // (100 + similarity)) - common[:, None] - common[None, :] + hub_n[0]
        link = shared >= least
        part = np.where(outside, np.arange(len(rep)), -1)  # those within are one part, through the hub
        two = bool((side == 1).any())
        out: list[tuple[int, int]] = []
        for a in np.flatnonzero(side == 0):
            partners = np.flatnonzero(link[a] & ((side == 1) if two else (np.arange(len(rep)) > a)))
            for b in partners[np.unique(part[partners], return_index=True)[1]]:
                if part[b] != part[a]:
                    out.append((rep[a], rep[b]))
                    part[part == part[b]] = part[a]
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]

    return solve


def links_of(pairs: DataFrame, similarity: int) -> DataFrame:
    """(hub, rep) links of settled pairs: members with their hub, and those that other members need."""
    deltas = pairs.select("hub", (~linked(similarity)).alias("outside"), "rep", "n", "common", "hub_n", "delta")
    among = dealt_blocks(deltas, "hub", F.octet_length("delta") / 8).mapInArrow(by_block("hub", delta_links(similarity)), "hub long, rep long")
    return written(pairs.filter(linked(similarity)).select("hub", "rep").unionByName(among), "near-links")


def candidates(sketches: list[np.ndarray], n: np.ndarray, similarity: int) -> np.ndarray:
    """Which pairs of sketches do not rule the similarity out.

    Values up to the lesser of two sketches' ends are a sample of both sets
    without bias, drawn without replacement, so its error shrinks as it nears
    the whole; a sketch shorter than SKETCH is the whole set and has no end.
    """
    end = np.array([x[-1] if len(x) >= SKETCH else np.iinfo(np.int64).max for x in sketches])
    limit = np.minimum(end[:, None], end[None, :])
    mine = np.stack([np.searchsorted(x, limit[k], "right") for k, x in enumerate(sketches)])
    common, s = overlaps(sketches), similarity / 100
    union = np.maximum(mine + mine.T - common, 1)
    left_out = np.clip(1 - union * (1 + s) / (n[:, None] + n[None, :]), 0, 1)
    whole = limit == np.iinfo(np.int64).max
    slack = np.where(whole, 0, SLACK * np.sqrt(s * (1 - s) / union * left_out) + 1 / union)
    sizes = np.minimum(n[:, None], n[None, :]) * 100 >= np.maximum(n[:, None], n[None, :]) * similarity
    return sizes & (common / union >= s - slack - 1e-6)


def covering_stars(similarity: int):
    """Rows of a block of sketches to stars: hubs with members, so that both ends of each candidate pair are members of one hub, or one is the hub."""
    def solve(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        side, rep, n, part, hubs_of = (np.asarray(t.column(c), dtype=np.int64) for c in ("side", "rep", "n", "part", "hub"))
        near = candidates([np.asarray(x, np.int64) for x in t.column("sketch").to_pylist()], n, similarity)
        names = t.column("hubs").to_pylist()
        listed, where = np.unique(np.concatenate([np.asarray(x, np.int64) for x in names]), return_inverse=True)
        earlier = np.zeros((len(rep), int(np.searchsorted(listed, hubs_of[0]))), np.float32)
        owner = np.repeat(np.arange(len(rep)), [len(x) for x in names])
        before = where < earlier.shape[1]
        earlier[owner[before], where[before]] = 1
        apart = side[:, None] != side[None, :] if (side == 1).any() else ~np.eye(len(rep), dtype=bool)
        todo = near & apart & (part[:, None] != part[None, :]) & (earlier @ earlier.T == 0)
        hubs, members = [], []
        while True:
            wanted = todo.sum(axis=1)
            hub = int(np.argmax(wanted))
            if not wanted[hub]:
                break
            star = np.flatnonzero(near[hub] & (wanted > 0) & (np.arange(len(rep)) != hub))
            hubs.append(np.full(len(star), rep[hub]))
            members.append(rep[star])
            star = np.append(star, hub)
            todo[np.ix_(star, star)] = False
        return (np.concatenate(hubs), np.concatenate(members)) if hubs else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    return solve


def far_stars(stars: DataFrame, near: DataFrame, links: DataFrame, reps: DataFrame, similarity: int) -> DataFrame:
    """(hub, rep) pairs that cover what step 2 left open among the members of each hub: far members with each other and with the near ones that missed the hub."""
    judged = near.select("hub", "rep", linked(similarity).alias("linked"))
    rest = stars.join(judged, ["hub", "rep"], "left").filter("linked IS NULL OR NOT linked").select("hub", "rep", "n", F.col("linked").isNull().alias("outside"))
    rest = written(rest, "near-rest")
    part = links.groupBy("rep").agg(F.min("hub").alias("part"))
    part = part.unionByName(links.select(F.col("hub").alias("rep"), F.col("hub").alias("part")).distinct()).groupBy("rep").agg(F.min("part").alias("part"))
    own = rest.groupBy("rep").agg(F.collect_set("hub").alias("hubs")).join(part, "rep", "left").select("rep", "hubs", F.coalesce("part", "rep").alias("part"))
    own = written(with_labels(reps.select("rep", "sketch"), own, ["rep"]), "near-own")
    blocks = dealt_blocks(rest, "hub", F.lit(SKETCH)).join(own, "rep").repartition("hub", "block").sortWithinPartitions("hub", "block")
    return blocks.mapInArrow(by_block("hub", covering_stars(similarity)), "hub long, rep long").filter("hub <> rep").distinct()


def components(links: DataFrame) -> DataFrame:
    """(rep, component) of every end of a (hub, rep) link: the smallest id that can be reached.

    Labels go from members to hubs and back, then each label takes the label
    of the label, so the rounds grow with the logarithm of the longest path.
    """
    degree = written(links.groupBy("hub").agg(F.count(F.lit(1)).alias("links")), "near-degree")
    labels = written(links.select(F.col("hub").alias("rep")).union(links.select("rep")).distinct().withColumn("component", F.col("rep")), "near-labels")
    while True:
        raised = links.join(labels, "rep").groupBy("hub").agg(F.min("component").alias("seen"))
        hubs = degree.join(raised, "hub").join(labels.select(F.col("rep").alias("hub"), F.col("component").alias("own")), "hub").select("hub", "links", F.least("seen", "own").alias("component"))
        hubs = written(hubs, "near-hubs")
        sunk = join_groups(links, hubs, ["hub"], "links").select("rep", "component").union(hubs.select(F.col("hub").alias("rep"), "component"))
        lower = written(sunk.union(labels.select("rep", "component")).groupBy("rep").agg(F.min("component").alias("component")), "near-lower")
        sizes = lower.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
        onward = written(sizes.join(lower.select(F.col("rep").alias("component"), F.col("component").alias("next")), "component"), "near-next")
        after = written(join_groups(lower, onward, ["component"], "size").select("rep", F.col("next").alias("component")), "near-labels")
        changed = after.join(labels.withColumnRenamed("component", "old"), "rep").filter("component <> old").limit(1).count()
        discard(labels, hubs, lower, onward)
        if not changed:
            discard(degree)
            return after
        labels = after


def link_components(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document; similarity is a percentage."""
    rows = written(profiles(docs), "near-profiles")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "print", "n", "sketch"))).alias("first")
    classes = rows.filter("n > 0").groupBy("key_a", "key_b").agg(first, F.count(F.lit(1)).alias("rows"))
    classes = written(classes.select("key_a", "key_b", "rows", F.col("key_a").alias("rep"), "first.doc_id", "first.print", "first.n", "first.sketch"), "near-classes")
    reps = classes.filter("doc_id IS NOT NULL").select("rep", "n", "sketch")
    lists = written(inverted_lists(reps), "near-lists")
    top = F.max(F.struct("fame", (-F.col("rep")).alias("minus"), "n")).alias("top")
    heads = lists.groupBy("value").agg(top, F.count(F.lit(1)).alias("members")).filter("members > 1")
    heads = written(heads.select("value", (-F.col("top.minus")).alias("hub"), F.col("top.n").alias("hub_n"), "members"), "near-heads")
    stars = written(join_groups(lists, heads, ["value"], "members").filter("rep <> hub").select("hub", "rep", "n", "hub_n").distinct(), "near-stars")
    near = settled(near_hub(stars, reps, similarity), docs, classes)
    links = links_of(near, similarity)
    far = settled(far_stars(stars, near, links, reps, similarity), docs, classes)
    named = rows.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id", F.col("key_a").alias("rep"))
    twice = named.groupBy("doc_id").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).filter("hub <> last").select("doc_id", "hub")
    same_id = named.join(twice, "doc_id").filter("rep <> hub").select("hub", "rep")
    labels = components(written(links.unionByName(links_of(far, similarity)).unionByName(same_id).distinct(), "near-all"))
    joined = classes.filter("doc_id IS NOT NULL").select("rep", "doc_id").join(labels, "rep")
    smallest = written(joined.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("size")), "near-smallest")
    final = join_groups(joined, smallest, ["component"], "size").select("rep", "component_id")
    homes = classes.select("key_a", "key_b", "rows", "rep", "doc_id").join(final, "rep", "left").select("key_a", "key_b", "rows", F.coalesce("component_id", "doc_id").alias("component"))
    homes = written(homes, "near-homes")
    discard(near, far, lists, stars, classes)
    full = join_groups(rows.filter("n > 0").select("doc_id", "n", "key_a", "key_b"), homes, ["key_a", "key_b"], "rows").select("doc_id", "n", "component")
    out = full.unionByName(rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component")))
    component = F.when(F.col("doc_id").isNotNull(), F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The documents that stay, with all their columns: of each component the smallest id. Rows without a doc_id stay; rows that share an id stay or go together."""
    return drop_ids(docs, link_components(docs, similarity).filter(~F.col("kept")).select("doc_id"))


#: The same for 85 percent, by brute force; for small tables.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
e AS MATERIALIZED (SELECT doc_id, unnest(g) AS g FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM c JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * n >= 85 * (len(a.g) + len(b.g) - n)),
m AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, m.y FROM r JOIN m ON m.x = r.seen)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, k.component_id, s.doc_id = k.component_id AS kept FROM s JOIN (SELECT id, min(seen) AS component_id FROM r GROUP BY id) k ON k.id = s.doc_id
"""
