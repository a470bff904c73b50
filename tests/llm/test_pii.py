import hashlib
import random
import re

import numpy as np

from graphloom.llm import pii


def brute_base(text):
    text = text or ""
    out = {"email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]}
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out["card"] = []
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 13 <= len(d) <= 19 and sum((int(c) * 2 - 9 * (int(c) > 4)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0:
            out["card"].append(m.span())
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def texts():
    rng = random.Random(9)
    parts = ["a.b@", "x@y.com", "@", "mail.de", "1.2.3.4", ".", "255", "300.1.1.1", "4111 1111 1111 1111", "4111-1111", "1", "+49 (30) 123-4567", "+", " ", "-", "(", "12", "é", "\n", "foo@bar", "0000", "_"]
    out = [None, "", "a" * 100_000, "a@" * 20_000, "1" * 100_000, "+1" + " " * 50_000, "1." * 30_000, "0" * 5000 + ".1.1.1"]
    return out + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(1500)]


def test_base_against_brute_force(make_docs):
    rows = [(i, t) for i, t in enumerate(texts()) if t is None or len(t) < 40_000]
    got = {r.doc_id: r for r in pii.find_personal_data(make_docs(rows, ["spans", "added"])).collect()}
    for i, t in rows:
        want = brute_base(t)
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(want[k]) for k in pii.BASE], t
        said = ",".join(f"{k}:{s}:{e}" for k in pii.BASE for s, e in want[k])
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.spans == said or r.spans.startswith(said)


def test_hard_texts_take_linear_time():
    for t in texts()[:8]:
        pii.candidates(t or "", pii.base_spans(t or ""))


def test_votes_decide(make_docs):
    rows = [(i, f"My social security number (ssn) is 219-09-{1000 + i}, mail a{i}@b.com") for i in range(40)]
    rows += [(100 + i, f"order ref 000-00-{1000 + i} of the model") for i in range(40)]
    got = {r.doc_id: r.spans for r in pii.find_personal_data(make_docs(rows)).collect()}
    assert all("social_security" in got[i] for i in range(40)) and not any("social_security" in got[100 + i] for i in range(40))


def test_em_recovers_reliabilities():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.4
    kind = np.arange(4000) % 2 + 4
    right = np.where(kind == 4, 0.9, 0.75)[:, None]  # labelers are worse for the second kind
    votes = np.where(rng.random((4000, 5)) < 0.6, np.where(rng.random((4000, 5)) < right, np.where(truth[:, None], 1, -1), np.where(truth[:, None], -1, 1)), 0)
    distinct, inverse, counts = np.unique(np.column_stack([kind, votes]), axis=0, return_inverse=True, return_counts=True)
    posterior, rates = pii.reliabilities(distinct[:, 0], distinct[:, 1:], counts.astype(float), np.zeros(len(distinct), bool))
    assert ((posterior[inverse.ravel()] > 0.5) == truth).mean() > 0.85
    said_for = {k: rates[k][1, :, 2] / (rates[k][1, :, 0] + rates[k][1, :, 2]) for k in (4, 5)}  # of the votes on true spans, those for
    assert (said_for[4] > said_for[5]).all() and abs(said_for[4].mean() - 0.9) < 0.05


def brute_spans(texts):
    """Base and added spans of all texts, by plain loops over candidates and the trained pattern table."""
    found = [(pii.base_spans(t), t) for t in texts]
    votes = {}
    for base, t in found:
        for k, p in [*pii.base_patterns(t, base), *((c[0], c[3]) for c in pii.candidates(t, base))]:
            votes[k, p] = votes.get((k, p), 0) + 1
    seen = sorted(votes)
    kinds, parsed = np.array([k for k, _ in seen]), [[int(v) for v in p.split(",")] for _, p in seen]
    counts = np.array([votes[s] for s in seen], float)
    posterior, _ = pii.reliabilities(kinds, np.array(parsed)[:, :5], counts, kinds < 4)
    x = pii.design(kinds, parsed)
    w = pii.fit_classifier(x, posterior, counts)
    report = {s for s, row in zip(seen, x) if 1 / (1 + np.exp(-(row @ w[:-1] + w[-1]))) >= pii.REPORT}
    return [[f"{pii.KINDS[k]}:{s}:{e}" for k, s, e, p in sorted(pii.candidates(t, base)) if (k, p) in report] for base, t in found]


def test_added_spans_against_plain_loops(make_docs):
    rng = random.Random(4)
    parts = ["ssn is 219-09-%04d, ", "order ref 000-00-%04d ", "call 415-555-%04d ", "Dear Maria Smith, ", "Foo Bar %d ", "born 12.03.1980 ", "version 99.99.2099 ", "mail a%d@b.com ", "write bob [at] example [dot] com "]
    texts = ["".join(p % rng.randint(1000, 9999) if "%" in p else p for p in rng.choices(parts, k=4)) for _ in range(80)]
    got = {r.doc_id: r for r in pii.find_personal_data(make_docs(list(enumerate(texts)))).collect()}
    for i, want in enumerate(brute_spans(texts)):
        added = [x for x in got[i].spans.split(",") if x and x.split(":")[0] not in pii.BASE]
        assert added == want and got[i].n_added == len(want)


def test_nothing_within_base_findings_is_added():
    text = "1.1.1.1-1.1.1.1-1.1.1.1-1.1.1.1-1.1.1.1%555-123-4567@x.com"
    assert pii.candidates(text, pii.base_spans(text)) == []


def test_very_long_texts_end_to_end(make_docs):
    rows = [(1, "word " * 200_000 + "a@b.com"), (2, "a@" * 200_000), (3, "1.2.3.4 " * 50_000)]
    got = {r.doc_id: r for r in pii.find_personal_data(make_docs(rows)).collect()}
    assert (got[1].n_email, got[2].n_email, got[3].n_ip) == (1, 0, 50_000) and got[1].spans == "email:1000000:1000007"


def test_empty_and_repeated(make_docs):
    assert pii.find_personal_data(make_docs([])).count() == 0
    assert pii.find_personal_data(make_docs([(1, "x@y.com")] * 2 + [(None, None)])).count() == 3
