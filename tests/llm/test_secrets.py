import hashlib
import random
import re

from graphloom.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
OTHER = {"identifier": re.compile(r"""(?:user_?(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{3,})""", re.I | re.A), "secret": re.compile(secrets.OPAQUE), "endpoint": re.compile(secrets.ENDPOINT)}


def base(text):
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def brute(text):
    text = text or ""
    sure = base(text)
    weak = [(k, *m.span()) for k, p in OTHER.items() for m in p.finditer(text)]
    weak += [("secret", *m.span()) for m in ASSIGN.finditer(text) if 6 <= len(m[2]) < 12]
    parts = sure + weak
    near = lambda s, kinds: any(o != s and o[0] in kinds and (s[1] - o[2] <= secrets.SCOPE and o[1] - s[2] <= secrets.SCOPE) for o in parts)
    linked, links = [], []
    said = lambda xs: ",".join(":".join(map(str, x)) for x in xs)
    rank = secrets.KINDS.index
    nearest = lambda s, kinds: min((max(0, o[1] - s[2], s[1] - o[2]), o[1], rank(o[0]), o[2], said([o])) for o in parts if o[0] in kinds)[-1]
    for s in sorted(weak, key=lambda s: (s[1], rank(s[0]))):
        if any(b[1] < s[2] and s[1] < b[2] for b in sure):
            continue
        ids, keys = near(s, ("access", "identifier")), near(s, ("assign", "hex", "secret"))
        if {"secret": ids, "identifier": keys, "endpoint": ids and keys}[s[0]]:
            linked.append(s)
            links += [f"{said([s])}>{nearest(s, kinds)}" for kinds, weak_kinds in ((secrets.IDS, ("secret", "endpoint")), (secrets.KEYS, ("identifier", "endpoint"))) if s[0] in weak_kinds]
    spans = sorted(sure + linked, key=lambda s: (s[1], secrets.KINDS.index(s[0])))
    n = [sum(s[0] == k for s in sure) for k in secrets.BASE]
    return (*n, hashlib.sha256(said(sure).encode()).hexdigest(), said(spans), len(linked), ",".join(links))


def texts():
    rng = random.Random(5)
    parts = ["password=", "Token: '", "api_key\" = ", "hunter2", "abcdefghijkl", "AKIA", "AKIAABCDEFGHIJKLMN", "0123456789abcdef0", "user: bob.smith", "login=root1", "https://db.example.com/x", " ", "\n", "aZ09" * 6, "ü中", "secret=token=abcdefghijkl12", ", ", "x" * 350, "token: password: abcdefghijklmnop"]
    return [None, "", "nothing here", "AKIA" * 30_000, "password=" * 5_000, "a1" * 60_000] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(150)]


def test_against_brute_force(make_docs):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in secrets.find_secrets(make_docs(rows, ["row", "kind", "spans"])).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans, r.n_linked, r.links) == brute(t), (t or "")[:300]


def test_weak_parts_need_company(make_docs):
    got = {r.doc_id: r.spans for r in secrets.find_secrets(make_docs([(1, "password=hunter2"), (2, "user=admin password=hunter2 at https://x.io/"), (3, "user=admin " + "-" * 400 + " password=hunter2")])).collect()}
    assert got == {1: "", 2: "identifier:0:10,secret:11:27,endpoint:31:44", 3: ""}


def test_no_python_in_the_plan(make_docs):
    plan = secrets.find_secrets(make_docs([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_empty_repeated_and_null_ids(make_docs):
    assert secrets.find_secrets(make_docs([])).count() == 0
    got = secrets.find_secrets(make_docs([(1, "AKIAABCDEFGHIJKLMN")] * 2 + [(None, None)])).collect()
    assert sorted(r.n_access for r in got) == [0, 1, 1]


def test_sql_says_the_same(make_docs):
    import duckdb
    import pandas as pd

    rows = [(i, t) for i, t in enumerate(texts()) if t is None or len(t) < 30_000]
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    want = {r[0]: r[1:] for r in duckdb.sql(secrets.ORACLE_SQL).fetchall()}
    assert want == {i: brute(t) for i, t in rows}


def test_long_tokens_count_whole(make_docs):
    token = "abcDEF" * 14 + "0123"
    got = secrets.find_secrets(make_docs([(1, "user: bob " + token)])).first()
    assert got.spans == f"identifier:0:9,secret:10:{10 + len(token)}" and got.links == f"identifier:0:9>secret:10:{10 + len(token)},secret:10:{10 + len(token)}>identifier:0:9"


def test_a_dense_document(make_docs):
    text = "user=abc token=secr3t " * 3_000
    got = secrets.find_secrets(make_docs([(1, text)])).first()
    assert got.n_linked == 6_000
