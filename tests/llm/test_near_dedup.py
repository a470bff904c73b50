import random
import re
from itertools import combinations

import pytest

from graphloom.llm import near_dedup


def shingles(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, similarity):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= similarity * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = [None, "", " \t ", "one", "One", "one two three", "ONE two  three", "a b c d e", "a b c d e f"]
    for _ in range(40):
        rows.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 200))))
    for _ in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 250))]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = f"e{rng.random()}"
            rows.append(" ".join(w))
    for _ in range(60):
        rows.append(" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randint(0, 25))]))
    chain = [f"c{i}" for i in range(80)]
    for _ in range(12):
        rows.append(" ".join(chain))
        chain = chain[2:] + [f"d{rng.random()}", f"d{rng.random()}"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "similarity"), [(1, 85), (2, 80)])
def test_against_brute_force(make_docs, seed, similarity):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.link_components(make_docs(rows, ["rep", "n", "value"]), similarity).collect()}
    want = brute(rows, similarity)
    assert got == want


def test_blocks_find_what_hubs_miss(make_docs, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    monkeypatch.setattr(near_dedup, "COLUMNS", 7)
    rows = corpus(4)
    got = {r.doc_id: r.component_id for r in near_dedup.link_components(make_docs(rows), 85).collect()}
    assert got == {i: v[1] for i, v in brute(rows, 85).items()}


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101)], "hub long, rep long")
    got = {r.rep: r.component for r in near_dedup.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_defined_cases(make_docs):
    assert near_dedup.link_components(make_docs([])).count() == 0
    rows = near_dedup.link_components(make_docs([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (5, "A b c d e f")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in rows) == [(0, 0, True), (3, 3, True), (3, 3, True), (5, 3, False)]
    kept = near_dedup.keep_one_of_each(make_docs([(3, "a b c d e f"), (5, "A b c d e f"), (6, "z")]))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and sorted(r.doc_id for r in kept.collect()) == [3, 6]


def far_group(seed, members=60):
    """Near copies of one text, each too far from it, with some that share their changes."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(120)]
    changed = lambda words, n: [f"x{rng.random()}" if i in set(rng.sample(range(len(words)), n)) else w for i, w in enumerate(words)]
    rows = [" ".join(base)]
    for _ in range(members):
        rows.append(" ".join(changed(base, 5)))
    for _ in range(8):
        child = changed(base, 5)
        rows += [" ".join(child), " ".join(changed(child, 1)), " ".join(changed(child, 1))]
    return list(enumerate(rows))


def test_members_that_miss_the_hub_meet_each_other(make_docs):
    rows = far_group(7)
    got = {r.doc_id: r.component_id for r in near_dedup.link_components(make_docs(rows), 80).collect()}
    assert got == {i: v[1] for i, v in brute(rows, 80).items()}


def test_rows_that_share_an_id_link_as_any_of_their_texts(make_docs):
    big = " ".join(f"w{i}" for i in range(60))
    docs = make_docs([(3, "short one"), (3, big), (4, big + " more"), (5, "other text")])
    assert sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.link_components(docs, 80).collect()) == [(3, 3, True), (3, 3, True), (4, 3, False), (5, 5, True)]


def test_clashing_columns_ties_and_long_texts(make_docs):
    long_text = " ".join(f"w{i % 9973}v{i}" for i in range(60_000))
    docs = make_docs([(2, long_text), (1, long_text + " end"), (7, "a b c d e f"), (8, "a b c d e f"), (9, None), (None, long_text)], ["gone_id", "rep", "hub", "value", "print", "first"])
    kept = near_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.select("doc_id").collect() if r.doc_id is not None) == [(False, 1), (False, 7), (False, 9)]
    assert kept.filter("doc_id IS NULL").count() == 1


def test_delta_links_are_exact():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(3)
    hub = set(range(100))
    sets = []
    for k in range(30):
        s = set(hub) - set(rng.sample(range(100), rng.randint(0, 20))) | {1_000 + rng.randrange(40) for _ in range(rng.randint(0, 20))}
        sets.append(s)
    jaccard = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    outside = [not jaccard(s, hub) for s in sets]
    rows = pa.table({"side": [0] * 30, "rep": list(range(30)), "n": [len(s) for s in sets], "common": [len(s & hub) for s in sets], "hub_n": [100] * 30, "outside": outside, "delta": [np.array(sorted(s ^ hub), np.int64).tobytes() for s in sets]})
    a, b = near_dedup.delta_links(80)(rows)
    assert all(jaccard(sets[x], sets[y]) for x, y in zip(a.tolist(), b.tolist())) and len(a) < 30
    root = {i: (i if outside[i] else -1) for i in range(30)}

    def merged(pairs, root):
        root = dict(root)
        for x, y in pairs:
            old, new = root[x], root[y]
            root = {k: new if v == old else v for k, v in root.items()}
        return {frozenset(k for k in root if root[k] == v) for v in root.values()}

    assert merged(zip(a.tolist(), b.tolist()), root) == merged([(x, y) for x, y in combinations(range(30), 2) if jaccard(sets[x], sets[y])], root)
