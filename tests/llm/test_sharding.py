import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from graphloom.llm import sharding


def check(rows, got, shards):
    size = defaultdict(int)
    slots, home = defaultdict(list), defaultdict(set)
    for r in got:
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    text_of = dict(rows)
    for r in got:
        if r.doc_id is not None:
            t = (text_of[r.doc_id] or "").encode()
            assert r["size"] == len(t) + 16 and r.text_crc32 == zlib.crc32(t)
            home[t].add(r.shard)
    assert all(len(x) == 1 for x in home.values())
    return size


def test_balance_groups_and_slots(make_docs):
    rng = random.Random(1)
    rows = [(i, "w" * rng.randint(0, 3000) + str(i)) for i in range(600)]
    rows += [(1000 + i, "copy" * 200) for i in range(30)] + [(2000, None), (2001, "")]
    got = sharding.shard_documents(make_docs(rows, ["shard", "block", "size"]), 7, bucket_items=100).collect()
    assert len(got) == len(rows)
    size = check(rows, got, 7)
    assert max(size.values()) - min(size.values()) <= 0.01 * sum(size.values()) / 7


def test_levels_agree_with_the_law(make_docs):
    rng = random.Random(2)
    rows = [(i, "w" * rng.randint(0, 500) + str(i)) for i in range(300)]
    import graphloom.llm.sharding as m

    groups = make_docs(rows).selectExpr("doc_id as key_a", "doc_id as key_b", "cast(length(text) as long) as size")
    shard = {r.key_a: r.shard for r in m.assign_groups(groups, 4, bucket_items=20, fan_in=3).collect()}
    assert len(shard) == 300
    sums = Counter()
    for i, t in rows:
        sums[shard[i]] += len(t)
    assert max(sums.values()) - min(sums.values()) <= 40


def test_differencing_beats_a_known_case():
    part, sums = sharding.difference_sizes(np.array([8, 7, 6, 5, 4]), 2)
    assert sorted(sums.tolist()) == [14, 16]
    assert [int(np.array([8, 7, 6, 5, 4])[part == k].sum()) for k in (0, 1)] == sums.tolist()


def test_empty_and_repeated(make_docs):
    assert sharding.shard_documents(make_docs([])).count() == 0
    got = sharding.shard_documents(make_docs([(1, "a"), (1, "a"), (None, None)])).collect()
    assert len(got) == 3
