import hashlib
import random

import pytest

import corpus_pipeline
from graphloom.llm import bpe, near_dedup

from .test_near_dedup import brute


@pytest.fixture
def tables(spark, make_docs, tmp_path):
    rng = random.Random(8)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("nt", "r", "sh", "ly")]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    items = [prose(30) for _ in range(5)]
    rows, quality = [], {}
    for i in range(160):
        good = i % 4 != 0
        t = prose(rng.randint(40, 120))
        rows.append((i, t if good else t.upper().replace(" ", "!! ")))
        quality[i] = int(good)
    rows += [(200, rows[1][1]), (201, rows[1][1].capitalize()), (202, rows[2][1] + " more"), (203, rows[3][1] + "\n" + items[2]), (204, None), (205, "")]
    docs = make_docs(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in quality.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows, quality, str(tmp_path)


def test_stages_do_what_they_say(spark, tables):
    rows, quality, where = tables
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, where).collect()}
    good = [(i, t) for i, t in rows if quality.get(i, 1)]
    last = {}
    for i, t in good:
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        last[key] = max(last.get(key, -1), i)
    exact = [(i, t) for i, t in good if i in last.values()]
    near = [(i, t) for i, t in exact if brute(exact, near_dedup.SIMILARITY)[i][2]]
    want = {i: t or "" for i, t in near if i != 203}
    assert out.keys() == want.keys()
    encoding = bpe.codec(bpe.default_ranks_path())[0]
    for i, t in want.items():
        assert list(out[i].ids) == encoding.encode_ordinary(t) and out[i].n_tokens == len(out[i].ids)
        assert out[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_all_but_the_last_return_documents(spark, tables):
    _, _, where = tables
    docs = spark.read.parquet(f"{where}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, where).columns == docs.columns


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stages_on_defined_cases(spark, make_docs, tables, stage):
    """Empty tables; null ids and texts; repeated rows; ties; very long texts; columns named like those that stages work with."""
    _, _, where = tables
    columns = ["gone_id", "rep", "hub", "digest", "keep_id", "kept", "grade", "item_id", "row_key", "text_sha256"]
    empty = make_docs([], columns)
    assert stage[1](spark, empty, where).columns == empty.columns and stage[1](spark, empty, where).count() == 0
    words = "bant ber bish boly dant der dish doly fant fer fish foly gant ger gish goly kant ker kish koly".split()
    text = lambda n, k: " ".join(words[(i * i + k * i + i // 7) % 20] for i in range(n)) + "."
    rows = [(1, text(60, 3)), (1, text(60, 3)), (2, text(80, 5)), (None, text(70, 11)), (None, None), (4, None), (5, ""), (6, text(60_000, 13)), (7, text(60, 17))]
    docs = make_docs(rows, columns)
    out = stage[1](spark, docs, where)
    assert out.columns == docs.columns
    left = [(r.doc_id, r.text) for r in out.collect()]
    assert set(left) <= set(rows) and left.count((1, rows[0][1])) in (0, 2)


def test_encoding_stage_on_defined_cases(spark, make_docs, tables):
    _, _, where = tables
    rows = [(1, "a b"), (1, "a b"), (None, "c"), (None, None), (4, "long text " * 20_000)]
    out = corpus_pipeline.STAGES[-1][1](spark, make_docs(rows, ["ids", "row_key", "parts"]), where).collect()
    assert sorted((r.doc_id or 0, r.decoded_sha256) for r in out) == sorted((i or 0, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert corpus_pipeline.STAGES[-1][1](spark, make_docs([]), where).count() == 0
