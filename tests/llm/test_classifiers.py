import random
import zlib

import numpy as np

from graphloom.llm import quality, toxicity

VOCABULARY = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("nt", "r", "sh", "ly")]
BAD = ["idiot", "moron", "scum"]


def labelled(n, seed=1):
    rng = random.Random(seed)
    rows, toxic = [], {}
    for i in range(n):
        w = [rng.choice(VOCABULARY) for _ in range(rng.randint(5, 300))]
        toxic[i] = int(rng.random() < 0.3)
        for _ in range(3 * toxic[i]):
            w.insert(rng.randrange(len(w)), rng.choice(BAD))
        rows.append((i, " ".join(w)))
    return rows, toxic


def test_toxicity_of_held_out_rows(spark, make_docs):
    rows, toxic = labelled(500)
    rows += [(1000, None), (1001, ""), (None, "no id")]
    labels = spark.createDataFrame([(i, 1, t) for i, t in toxic.items()] + [(2, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.scored_with_folds(make_docs(rows, ["score", "toxic"]), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in toxic]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == toxic[r.doc_id] for r in held]) > 0.95


def test_held_out_labels_are_not_read(spark, make_docs):
    rows, toxic = labelled(200, 2)
    make = lambda flip: spark.createDataFrame([(i, 1, (1 - t) if flip and zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in toxic.items()], "doc_id long, quality int, toxic int")
    a, b = ({r.doc_id: r.score for r in toxicity.scored_with_folds(make_docs(rows), make(flip)).collect()} for flip in (False, True))
    assert a == b


def plain_ratios(texts, toxic):
    """log P(w | u, toxic) - log P(w | u, other) by the docstring's formulas, over dictionaries."""
    from collections import Counter
    from math import log

    words_of = lambda t: [w.lower().strip(toxicity.EDGES) for w in t.split()]
    n = [Counter(), Counter()]
    for t, c in zip(texts, toxic):
        w = words_of(t)
        n[c].update(zip(["<s>", *w], w))
    both = n[0] + n[1]
    tokens = lambda c, u: sum(v for (x, _), v in c.items() if x == u)
    types = lambda c, u: sum(x == u for x, _ in c)
    cont = lambda c, w: sum(y == w for _, y in c)
    vocabulary = len({w for _, w in both})
    base = lambda w: max(cont(both, w) - 0.75, 0) / len(both) + 0.75 * vocabulary / len(both) / (vocabulary + 1)
    uni = lambda c, w: max(cont(n[c], w) - 1, 0) / len(n[c]) + len({y for _, y in n[c]}) / len(n[c]) * base(w)

    def p(c, u, w):
        s = tokens(both, u)
        shared = (max(both[u, w] - 1, 0) + types(both, u) * base(w)) / s if s else base(w)
        q, own = shared * uni(c, w) / base(w), tokens(n[c], u)
        return (max(n[c][u, w] - 1, 0) + types(n[c], u) * q) / own if own else q

    return lambda t: [log(p(1, u, w) / p(0, u, w)) for w, u in zip(words_of(t), ["<s>", *words_of(t)])]


def test_log_ratios_against_plain_counts(spark, monkeypatch):
    import pyarrow as pa

    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "b", "c,", "D", "e", "bad", "worse"][: 5 + 2 * (k % 2)]) for _ in range(rng.randint(0, 30))) for k in range(60)]
    rows = spark.createDataFrame([(t, k % 2) for k, t in enumerate(texts)], "text string, toxic int")
    want = plain_ratios(texts, [k % 2 for k in range(60)])
    for portion in (2_000_000, 3):
        monkeypatch.setattr(toxicity, "PORTION", portion)
        monkeypatch.setattr(toxicity, "FLUSH_PAIRS", 10 * portion)
        counts = toxicity.Counts.of(rows)
        assert portion > 3 or len(counts.pairs) > 2
        for t in ("a b c unknown bad", "worse bad e e", texts[1], "new words only"):
            _, words, before = toxicity.word_hashes(pa.array([t]))
            assert np.allclose(toxicity.log_ratios(counts, words, before), want(t), atol=1e-5)


def test_packed_pairs_come_back():
    rng = np.random.default_rng(1)
    before, words = (rng.integers(0, 1 << 63, 5000).astype(np.uint64) for _ in range(2))
    pairs = toxicity.merged(before, words, rng.integers(0, 9, (5000, 2)))
    got = [toxicity.unpacked(p["n"], p["data"]) for p in toxicity.packed(*pairs, 16)]
    again = toxicity.merged(*(np.concatenate(c) for c in zip(*got)))
    assert all((x == y).all() for x, y in zip(again, pairs))


def test_toxicity_of_long_repeated_and_tied_rows(spark, make_docs, monkeypatch):
    rows, toxic = labelled(300, 4)
    long_text = " ".join(VOCABULARY) + " "
    rows += [(5000, long_text * 3_000 + "idiot scum moron"), (5001, "idiot"), (5001, "idiot"), (5002, "idiot")]
    labels = spark.createDataFrame([(i, 1, t) for i, t in toxic.items()] * 2, "doc_id long, quality int, toxic int")
    plain = toxicity.scored_with_folds(make_docs(rows), labels).collect()
    same = [r.score for r in plain if r.doc_id in (5001, 5002)]
    assert len(plain) == len(rows) and len(set(same)) == 1 and len(same) == 3
    monkeypatch.setattr(toxicity, "PORTION", 100)  # more portions than a worker keeps
    many = {r.doc_id: r.score for r in toxicity.scored_with_folds(make_docs(rows), labels).collect()}
    assert all(abs(many[r.doc_id] - r.score) < 1e-6 for r in plain)


def test_toxicity_without_labels(spark, make_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.scored_with_folds(make_docs([(1, "a")]), labels).collect()] == [0.0]
    assert toxicity.scored_with_folds(make_docs([]), labels).count() == 0


def graded(n, seed=3):
    rng = random.Random(seed)
    rows, grade = [], {}
    for i in range(n):
        w = [rng.choice(VOCABULARY) for _ in range(rng.randint(30, 120))]
        grade[i] = rng.randrange(3)
        junk = (2 - grade[i]) * 0.3
        rows.append((i, " ".join(x.upper() + "$$$" if rng.random() < junk else x for x in w)))
    return rows, grade


def test_ordered_grades(spark, make_docs):
    rows, grade = graded(450)
    train = spark.createDataFrame([(i, g, 0) for i, g in grade.items() if i < 300] + [(1, None, 0)], "doc_id long, quality int, toxic int")
    docs = make_docs(rows + [(900, None)], ["kept", "grade"])
    model = quality.train(docs, train)
    assert list(model.grades) == [0, 1, 2] and model.thresholds[0] < model.thresholds[1]
    got = {r.doc_id: r for r in quality.grade_documents(docs, model).collect()}
    held = [i for i in grade if i >= 300]
    assert np.mean([round(got[i].expected_grade) == grade[i] for i in held]) > 0.9
    assert np.mean([got[i].kept == (grade[i] == 2) for i in held]) > 0.9
    two = {r.doc_id: r.tail_probability for r in quality.grade_documents(docs, model, wanted=1).collect()}
    assert all(two[i] >= got[i].tail_probability - 1e-9 for i in two)


def test_quality_without_ratings(spark, make_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = make_docs([(1, "a"), (None, None)])
    assert all(r.kept for r in quality.grade_documents(docs, quality.train(docs, labels)).collect())
    assert quality.keep_good(docs, labels).count() == 2 and quality.keep_good(make_docs([]), labels).count() == 0
