import hashlib

from graphloom.llm import exact_dedup
from graphloom.llm.common import scratch_path


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[lowered(t)]
        known = [x for x in ids if x is not None]
        keep = max(known) if known else None
        out.append((i, keep, len(ids), keep is None or i == keep, hashlib.sha256(lowered(t).encode()).hexdigest()))
    return out


ROWS = [(1, "Same"), (2, "same"), (3, None), (4, ""), (5, "ÄB"), (6, "äb"), (7, "x" * 100_000), (8, "X" * 100_000), (9, "alone"), (9, "alone"), (None, "same"), (None, "no id")]


def as_rows(df):
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=key)


def test_against_brute_force(make_docs):
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert as_rows(exact_dedup.assign_survivors(make_docs(ROWS, ["digest", "keep_id", "kept"]))) == sorted(brute(ROWS), key=key)


def test_empty_table(make_docs):
    assert exact_dedup.assign_survivors(make_docs([])).count() == 0


def test_index_persists_and_appends_only_new(spark, make_docs):
    path = scratch_path(spark, "index")
    index = exact_dedup.DigestIndex(spark, path, 4)
    index.append(exact_dedup.digest_groups(exact_dedup.digests(make_docs([(1, "a"), (2, "b")]))))
    index.close()
    again = exact_dedup.DigestIndex(spark, path, 4)
    new = exact_dedup.digest_groups(exact_dedup.digests(make_docs([(7, "B"), (8, "c")])))
    plan = again.unseen(new)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "SelectedBucketsCount" in plan
    again.append(new)
    again.append(new)
    assert sorted(r.keep_id for r in again.known().collect()) == [1, 2, 8]
    out = {r.doc_id: r for r in exact_dedup.assign_survivors(make_docs([(9, "A"), (10, "d")]), again).collect()}
    assert (out[9].keep_id, out[9].kept, out[10].kept) == (1, False, True)


def test_drop_duplicates_keeps_columns(make_docs):
    docs = make_docs([(1, "a"), (2, "A"), (3, "b")], ["digest"])
    out = exact_dedup.drop_duplicates(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [2, 3]


def test_other_texts_of_an_id_stay(make_docs):
    docs = make_docs([(5, "A text"), (7, "A text"), (7, "B text"), (9, "B text"), (None, "c"), (None, "b TEXT")], ["gone_id", "gone", "digest", "mark", "keep_id"])
    out = exact_dedup.drop_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id or 0, r.text) for r in out.collect())) == [(0, "c"), (7, "A text"), (9, "B text")]


def test_every_batch_meets_what_came_before(make_docs):
    rows = [(i, f"text {i % 7}") for i in range(60)]
    want = sorted(brute(rows))
    for batches in (1, 2, 5):
        assert as_rows(exact_dedup.assign_survivors(make_docs(rows), batches=batches)) == want


def test_drop_against_an_index_that_another_session_made(spark, make_docs):
    path = scratch_path(spark, "index")
    first = exact_dedup.DigestIndex(spark, path, 4)
    exact_dedup.assign_survivors(make_docs([(1, "a"), (2, "b")]), first)
    first.close()
    again = exact_dedup.DigestIndex(spark, path, 4)
    assert [r.doc_id for r in exact_dedup.drop_duplicates(make_docs([(11, "A"), (12, "c"), (13, "c")]), again).collect()] == [13]
