import hashlib
import random

import numpy as np
import pytest

from graphloom.llm import common
from graphloom.llm import substring_dedup as sub

W = sub.WINDOW


def brute(rows):
    rank = lambda i: sub.NO_ID if i is None else i
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - W + 1):
            s = b[k : k + W]
            first[s] = min(first.get(s, sub.NO_ID), rank(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - W + 1):
            if first[b[k : k + W]] < rank(i):
                gone[k : k + W] = b"\1" * W
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = ["the", "onre", "thé", "中文", "a", "edst", "wh", "ingly", "\n"]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    unique = lambda k: " ".join(f"{rng.random():.9f}" for _ in range(k))
    passages = [text(rng.randint(10, 40)) + unique(3) for _ in range(6)] + ["x" * 300, "ab" * 200]
    rows = [(1, None), (2, ""), (3, "short"), (4, "y" * 49), (5, "y" * 50), (6, "y" * 51), (7, "y" * 3000)]
    for i in range(n):
        t = unique(rng.randint(1, 6))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            t += p[a : a + rng.randint(1, len(p))] + unique(rng.randint(0, 2))
        rows.append((10 + i, t))
    rows += [(500 + i, rows[20][1]) for i in range(20)] + [(None, rows[25][1]), (None, rows[25][1]), (9, rows[30][1]), (9, rows[31][1]), (9, rows[31][1])]
    rng.shuffle(rows)
    return rows


def got_of(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize(("chunk", "flush", "local", "whole"), [(512 << 10, 400_000, 64, 1_000), (128, 50, 2, 5), (1_000, 200, 1, 0)])
def test_against_brute_force(make_docs, monkeypatch, chunk, flush, local, whole):
    for name, value in (("CHUNK", chunk), ("FLUSH_STRETCHES", flush), ("LOCAL_CONTENTS", local), ("WHOLE_STRETCHES", whole), ("BUCKET_STRETCHES", 3)):
        monkeypatch.setattr(sub, name, value)
    rows = corpus(chunk)
    assert got_of(sub.removal_digests(make_docs(rows, ["order", "print", "start"]))) == sorted(brute(rows), key=str)


def test_longest_previous_factors_of_a_string():
    rng = random.Random(4)
    for _ in range(200):
        s = "".join(rng.choice("ab") for _ in range(rng.randint(1, 30)))
        order = sorted(range(len(s)), key=lambda i: s[i:])
        lcp = lambda a, b: next((k for k in range(len(s)) if a + k >= len(s) or b + k >= len(s) or s[a + k] != s[b + k]), len(s))
        common = [0] + [lcp(order[k - 1], order[k]) for k in range(1, len(s))]
        got = dict(zip(order, sub.longest_previous_factors(np.array(order), np.array(common)).tolist()))
        for i in range(len(s)):
            assert got[i] == max([lcp(i, j) for j in range(i)], default=0)


def test_suffix_order():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    starts = np.arange(0, 400 - W + 1)
    order, common = sub.suffix_order(data, starts)
    texts = [data[s : s + W].tobytes() for s in starts[order]]
    assert texts == sorted(texts)
    for k in range(1, len(texts)):
        assert common[k] == next((x for x in range(W) if texts[k][x] != texts[k - 1][x]), W)


def test_empty_and_output_bytes(make_docs):
    assert sub.removal_digests(make_docs([])).count() == 0
    p = "é" * 40
    got = {r.doc_id: bytes(r.data) for r in sub.deduplicate(make_docs([(1, p), (2, "12 " + p + "34")])).collect()}
    assert got == {1: p.encode(), 2: b"12 34"}


def test_texts_are_shuffled_once_where_ids_are_not_broadcast(make_docs, spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(sub, "WHOLE_STRETCHES", 5)
    docs = make_docs(corpus(11), ["print", "order", "hit"])
    exchanges = lambda df: sum("Exchange" in line and "SinglePartition" not in line for line in df._jdf.queryExecution().executedPlan().toString().splitlines())
    out = sub.removal_digests(docs)
    assert got_of(out) == sorted(brute(corpus(11)), key=str)
    assert exchanges(out) <= 2  # the texts and their spans
    mixed = spark.createDataFrame([(1, 2, 0, 60, 5)], "order long, print long, start int, end int, anchor long")
    placed = sub.contexts(mixed, sub.doc_keys(docs))
    assert exchanges(placed) <= 2  # the texts and their places


def test_settled_windows_are_merged_by_document():
    windows = sub.Windows()
    for order in (1, 2):
        for start in range(40):
            windows.add(7, 0, order, 9, start, b"%050d" % start)
    rows = windows.rows()
    assert [r for r in rows if r[1] < 0] == [(0, -1, 2, 9, [0, 39 + W], b"")]
    assert sorted(r[4] for r in rows if r[1] == 0) == [[k] for k in range(40)] and all(r[2] == 1 for r in rows if r[1] == 0)
