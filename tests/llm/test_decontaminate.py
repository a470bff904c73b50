import random
from itertools import combinations

import numpy as np

from graphloom.llm import decontaminate as dec


def tokens(text):
    return [w for w in (x.lower().strip(dec.EDGES) for x in (text or "").split()) if w]


def brute(docs, items):
    """(document, item) to the most equal tokens, over all diagonals and all stretches with the share."""
    out = {}
    for d, text in docs:
        ours = tokens(text)
        for i, item in items:
            theirs = tokens(item)
            least = min(dec.MIN_MATCHED, len(theirs))
            for shift in range(-len(theirs) + 1, len(ours)):
                equal = [theirs[k] == ours[k + shift] for k in range(max(0, -shift), min(len(theirs), len(ours) - shift))]
                if len(theirs) < dec.MIN_ITEM or sum(equal) < least:
                    continue
                sums = np.concatenate([[0], np.cumsum(equal)])
                most = max((int(sums[b] - sums[a]) for a in range(len(equal)) for b in range(a + 1, len(equal) + 1) if sums[b] - sums[a] >= dec.MIN_SHARE * (b - a)), default=0)
                if most >= least:
                    out[d, i] = max(out.get((d, i), 0), most)
    return out


def test_masks_hit_substituted_stretches():
    looks = [[{o + k for k, c in enumerate(m) if c == "1"} for m in dec.MASKS for o in range(n - len(m) + 1)] for n in (12, 20)]
    for sets, n, bad in ((looks[0], 12, 2), (looks[1], 20, 4)):
        assert all(any(not s & set(c) for s in sets) for c in combinations(range(n), bad))


def test_against_brute_force(spark, make_docs):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 6, 8, 15, 30])))) for k in range(20)]
    docs = [(1, None), (2, ""), (3, items[5][1].upper() + "!")]
    for d in range(10, 70):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        if d % 2:
            t = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, 2)):
                t[rng.randrange(len(t))] = "zz"
            w[len(w) // 2 : len(w) // 2] = t
        docs.append((d, " ".join(w)))
    got = {(r.doc_id, r.item_id): r for r in dec.overlapping(make_docs(docs, ["item_id", "matched"]), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute(docs, items)
    assert {p: r.matched for p, r in got.items()} == want and len(want) > 20
    text, item = dict(docs), dict(items)
    for (d, i), r in got.items():
        ours, theirs = tokens(text[d])[r.first_token : r.end_token], tokens(item[i])
        assert r.matched >= dec.MIN_SHARE * len(ours) and r.matched <= sum(x in theirs for x in ours)


def test_every_portion_counts(spark, make_docs, monkeypatch):
    monkeypatch.setattr(dec, "PORTION_BYTES", 100)
    items = [(k, " ".join(f"a{k}b{j}" for j in range(20))) for k in range(12)]
    docs = make_docs([(k, "x " + t + " y") for k, t in items] + [(99, "clean text only")])
    got = dec.overlapping(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(k, k) for k in range(12)]
    left = dec.drop_contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == docs.columns and [r.doc_id for r in left.collect()] == [99]


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dec.overlapping(make_docs([]), none).count() == 0 and dec.overlapping(make_docs([(1, "a")]), none).count() == 0


def accepted(equal):
    """The most equal tokens of any stretch with the share, by all stretches; 0 where none has MIN_MATCHED."""
    sums = np.concatenate([[0], np.cumsum(equal)])
    most = max((int(sums[b] - sums[a]) for a in range(len(equal)) for b in range(a + 1, len(equal) + 1) if sums[b] - sums[a] >= dec.MIN_SHARE * (b - a)), default=0)
    return most if most >= dec.MIN_MATCHED else 0


def test_stretches_are_verified_as_defined():
    rng = np.random.default_rng(5)
    cases = [np.array([k not in bad for k in range(n)]) for n, few in ((12, 2), (16, 3)) for bad in combinations(range(n), few)]
    cases += [np.array([True] * 9 + [False] * 5 + [True] * 9)] + [rng.random(rng.integers(1, 60)) < rng.choice([0.5, 0.7, 0.8]) for _ in range(400)]
    for equal in cases:
        begin, end, matched = dec.best_stretch(equal)
        assert matched == equal[begin:end].sum() and matched >= dec.MIN_SHARE * (end - begin)
        assert (matched if matched >= dec.MIN_MATCHED else 0) == accepted(equal)


def test_every_accepted_stretch_has_a_seed():
    for matched in range(dec.MIN_MATCHED, 2 * dec.MIN_MATCHED):
        for n in range(matched, int(matched / dec.MIN_SHARE) + 1):
            stretches = np.array([(1 << n) - 1 - sum(1 << k for k in bad) for bad in combinations(range(1, n - 1), n - matched)])
            seeded = np.zeros(len(stretches), bool)
            for mask in dec.MASKS:
                for begin in range(n - len(mask) + 1):
                    seeded |= stretches >> begin & int(mask, 2) == int(mask, 2)
            assert seeded.all()


def test_every_fourth_token_substituted():
    for n in (13, 40, 100, 1000):
        item = [f"w{k}" for k in range(n)]
        held = dec.Benchmark.of([7], [" ".join(item)])
        text = " ".join("zz" if k % 4 == 3 else w for k, w in enumerate(item))
        assert [(f[1], f[4]) for f in held.overlaps(dec.pa.array([text]))] == [(7, n - n // 4)]


def test_nothing_is_lost():
    rng = random.Random(8)
    items = [(k, [f"{k}w{j}" for j in range(rng.randint(13, 40))]) for k in range(30)]
    docs = []
    for d in range(600):
        t = rng.choice(items)[1]
        t = [f"zz{d}" if rng.random() < 0.22 else w for w in t]
        docs.append(["x"] * rng.randint(0, 5) + t + ["y"] * rng.randint(0, 5))
    held = dec.Benchmark.of([i for i, _ in items], [" ".join(t) for _, t in items])
    got = {(f[0], f[1]): f[4] for f in held.overlaps(dec.pa.array([" ".join(w) for w in docs]))}
    want = {}
    for d, ours in enumerate(docs):
        for i, theirs in items:
            if set(theirs) & set(ours):
                shifts = {ours.index(w) - k for k, w in enumerate(theirs) if w in ours}
                most = max(accepted(np.array([ours[k + s] == w for k, w in enumerate(theirs) if 0 <= k + s < len(ours)])) for s in shifts)
                want |= {(d, i): most} if most else {}
    assert got == want and len(want) > 100


def test_frequent_seeds_on_both_sides(monkeypatch):
    import time

    items = [(k, " ".join(["same"] * 100)) for k in range(10)]
    held = dec.Benchmark.of([i for i, _ in items], [x for _, x in items])
    began = time.time()
    found = held.overlaps(dec.pa.array([" ".join(["same"] * 8_000), "same " * 12]))
    assert time.time() - began < 10
    assert sorted((f[0], f[1], f[4]) for f in found) == [(0, k, 100) for k in range(10)] + [(1, k, 12) for k in range(10)]
    rng = random.Random(2)
    few = dec.Benchmark.of([1, 2], ["a b a b a b a b a b a b c", "a a a a a a a a a a b"])
    texts = [" ".join(rng.choice("aab") for _ in range(rng.randint(8, 60))) for _ in range(40)]
    want = few.overlaps(dec.pa.array(texts))
    monkeypatch.setattr(dec, "HITS", 7)
    monkeypatch.setattr(dec, "CELLS", 20)
    assert few.overlaps(dec.pa.array(texts)) == want
    assert {(f[0], f[1]): f[4] for f in want} == brute(list(enumerate(texts)), [(1, "a b a b a b a b a b a b c"), (2, "a a a a a a a a a a b")])


def test_long_repeated_and_nameless_rows(spark, make_docs):
    item = " ".join(f"k{j}" for j in range(20))
    docs = make_docs([(None, item), (4, "word " * 200_000 + item), (4, "word " * 200_000 + item), (5, None)])
    got = dec.overlapping(docs, spark.createDataFrame([(7, item), (8, None), (None, "five words are too few")], "item_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.first_token, r.matched) for r in got) == [(0, 7, 0, 20), (4, 7, 200_000, 20), (4, 7, 200_000, 20)]
    assert [r.doc_id for r in dec.drop_contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()] == [5]
