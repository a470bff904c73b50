"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a span classifier decides.

Base findings (email, ip, card, phone) are fixed patterns with checks and are
always reported. Beyond them, candidate spans (national phone numbers, social
security numbers, account numbers, birth dates, written-out addresses, names)
are proposed by broad patterns, and five labelers vote for, against or not at
all on each:

- form: the strict rules of the kind (check digits, ranges, calendar);
- gazetteer: first names, titles and mail domains, those of the module or the
  caller's (a set of names, as large as a broadcast may be);
- context: words that announce the kind shortly before the span;
- against: words that announce something else (orders, versions, references);
- company: other personal data close by.

A two-class model of the votes is fitted by expectation-maximisation: each
labeler has its own rate of either vote in either class and for each kind, where
a kind with few spans leans on the rates over all kinds. The labelers vote on
base findings too, and these take part as known positives. The posteriors are
the soft labels of a logistic span classifier over kind, votes and the span's
surface. All of its features are categories, so both fits run over the counts of
distinct patterns, a table of bounded size that a group-by gathers from every
document; no rows are sampled.

Defined cases: null text counts as empty; a document without findings has zero
counts and empty spans; without candidates nothing is fitted; repeated rows
and null ids give a row each; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import id_and_text, text_parts, written

BASE = ("email", "ip", "card", "phone")
LABELERS = ("form", "gazetteer", "context", "against", "company")
#: Kinds that the method adds, after the base kinds in the order of spans.
ADDED = ("national_phone", "social_security", "account", "birth_date", "spelled_email", "name")
KINDS = BASE + ADDED
#: Probability from which an added span is reported.
REPORT = 0.5
CONTEXT_CHARS, COMPANY_CHARS = 48, 120

# Word lists.
FIRST_NAMES = frozenset(
    "Adam Ahmed Alan Albert Alex Alexander Alice Amanda Amy Ana Andrea Andreas Andrew Angela Anna Anne Antonio Barbara Ben Benjamin Bernd Brian Carla Carlos Carmen Carol Caroline Catherine Charles Christian Christine Claire Claudia Daniel David Deborah Diana Diego Dmitri Donald Edward Elena Elizabeth Emily Emma Eric Erika Eva Fatima Felix Fernando Francesca Francisco Frank Frederic "
    "Gabriel George Georg Gerhard Giovanni Giulia Hans Hassan Heinz Helen Helena Henri Henry Ingrid Irina Isabel Ivan Jack Jacques Jakob James Jan Jane Janet Jason Javier Jean Jennifer Jessica Jim Joan John Jonas Jorge Jose Joseph Juan Julia Julie Karen Karl Katharina Kevin Klaus Kumar Larissa Laura Lena Li Lisa Linda Louis Louise Lucas Lucia Luis Lukas Manuel Marco Margaret Maria Marie "
    "Mark Markus Martha Martin Mary Matthew Max Mehmet Michael Michel Miguel Mohamed Monika Natalia Nicole Nikolai Nina Olga Oliver Omar Pablo Patricia Patrick Paul Paula Pedro Peter Philip Pierre Rachel Rafael Rebecca Richard Robert Roberto Rosa Ruth Samuel Sandra Sara Sarah Sergei Sofia Sophie Stefan Stephen Steven Susan Svetlana Thomas Tim Tom Ursula Vera Victor Victoria Walter Wei William Yuki Yusuf".split()
)
TITLES = frozenset("Mr Mrs Ms Dr Prof Herr Frau Mme Monsieur Madame Sr Sra Don".split())
MAIL_DOMAINS = frozenset("com org net edu gov info de fr es io".split())
ANNOUNCING = {
    "email": ("mail", "email", "contact", "write", "reach", "address"),
    "ip": ("ip", "host", "server", "address", "client"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "contact"),
    "national_phone": ("phone", "tel", "call", "mobile", "fax", "contact"),
    "social_security": ("ssn", "social", "security", "tax"),
    "account": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "birth_date": ("born", "birth", "dob", "geboren", "nacido"),
    "spelled_email": ("mail", "contact", "write", "reach"),
    "name": ("name", "contact", "dear", "by", "from", "regards"),
}
AGAINST = ("order", "version", "isbn", "invoice", "ref", "ticket", "serial", "page", "model", "sku")

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){12,}")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NATIONAL = re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
SOCIAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
DATE = re.compile(r"(?<![0-9./-])[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}(?![0-9])")
SPELLED = re.compile(r"[A-Za-z0-9._-]{1,64}\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{1,64}(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?[A-Za-z0-9-]{1,64})+", re.IGNORECASE)
NAME = re.compile(r"(?<![A-Za-z0-9])[A-Z][a-z]{1,20}\.?\x20[A-Z][a-z]{1,20}(?![a-z])")
WORDS = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the address pattern, found from each @ so that long runs cost linear time."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = free + len(text[free:at].rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append((begin, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans by base kind."""
    ips = [m.span() for m in IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))] if "." in text else []
    cards = []
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            cards.append(m.span())
    phones = [m.span() for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15] if "+" in text else []
    return [emails(text), ips, cards, phones]


def well_formed(kind: str, said: str) -> int:
    digits = re.sub(r"[^0-9]", "", said)
    if kind == "national_phone":
        return 1 if digits[0] not in "01" and digits[3] not in "01" else -1
    if kind == "social_security":
        return -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    if kind == "account":
        plain = said.replace(" ", "")
        turned = plain[4:] + plain[:4]
        return 1 if int("".join(str(int(c, 36)) for c in turned)) % 97 == 1 else -1
    if kind == "birth_date":
        a, b, year = (int(x) for x in re.split(r"[./-]", said))
        return 1 if 1900 <= year <= 2025 and min(a, b) in range(1, 13) and max(a, b) <= 31 else -1
    if kind == "spelled_email":
        return 1
    return 0


def known(kind: str, said: str, names: frozenset[str]) -> int:
    if kind == "name":
        first = said.split()[0].rstrip(".")
        return 1 if first in names or first in TITLES else -1
    if kind in ("email", "spelled_email"):
        return 1 if WORDS.findall(said.lower())[-1:] and WORDS.findall(said.lower())[-1] in MAIL_DOMAINS else -1
    return 0


def pattern_of(text: str, kind: str, begin: int, end: int, near: bool, names: frozenset[str]) -> str:
    """The votes of the labelers on a span and its surface, as text. The rules of base kinds are those that found the span."""
    said = text[begin:end]
    before = WORDS.findall(text[max(0, begin - CONTEXT_CHARS) : begin].lower())[-5:]
    votes = (1 if kind in BASE else well_formed(kind, said), known(kind, said, names), int(any(w in ANNOUNCING[kind] for w in before)), -int(any(w in AGAINST for w in before)), int(near))
    return ",".join(map(str, votes)) + f",{min(3, (end - begin) // 8)},{int(begin > 0 and text[begin - 1] in '\"(<:=')}"


def base_patterns(text: str, base: list[list[tuple[int, int]]], names: frozenset[str] = FIRST_NAMES) -> list[tuple[int, str]]:
    """(kind, pattern) of every base finding."""
    every = sorted((s, e, k) for k, spans in enumerate(base) for s, e in spans)
    out = []
    for i, (begin, end, k) in enumerate(every):
        beside = every[max(0, i - 1) : i] + every[i + 1 : i + 2]
        out.append((k, pattern_of(text, KINDS[k], begin, end, any(abs(s - begin) <= COMPANY_CHARS for s, _, _ in beside), names)))
    return out


def candidates(text: str, base: list[list[tuple[int, int]]], names: frozenset[str] = FIRST_NAMES) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, pattern) of every candidate that overlaps no base finding."""
    taken = sorted(s for spans in base for s in spans)
    proposed = []
    for kind, pattern, needs in (("national_phone", NATIONAL, None), ("social_security", SOCIAL, "-"), ("account", ACCOUNT, None), ("birth_date", DATE, None), ("spelled_email", SPELLED, "at"), ("name", NAME, None)):
        if needs is None or needs in text:
            if kind == "spelled_email" and not re.search(r"[\[(]\x20?[aA][tT]\x20?[\])]", text):
                continue
            proposed += [(KINDS.index(kind), *m.span()) for m in pattern.finditer(text)]
    starts = [s for s, _ in taken]
    reach = list(accumulate((e for _, e in taken), max))  # the farthest end of the findings up to each
    out = []
    for k, begin, end in sorted(proposed, key=lambda p: (p[1], p[0])):
        i = bisect_left(starts, end)
        if i and reach[i - 1] > begin:
            continue
        near = any(abs(s - begin) <= COMPANY_CHARS for s in starts[max(0, i - 1) : i + 1])
        out.append((k, begin, end, pattern_of(text, KINDS[k], begin, end, near, names)))
    return out


SCANNED = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<string>, added array<struct<kind:int,start:int,end:int,pattern:string>>, sure array<struct<kind:int,pattern:string,times:long>>"


SCANNED_NAMES = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "added", "sure"]


def scan(docs: DataFrame, names: frozenset[str] = FIRST_NAMES) -> DataFrame:
    """Base findings and candidates of every document, and how often base findings have each pattern; one pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(names)
    sure_type = pa.list_(pa.struct([("kind", pa.int32()), ("pattern", pa.string()), ("times", pa.int64())]))
    added_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.string())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_parts(batches):
            counts, digests, listed, added, sure = [[] for _ in BASE], [], [], [], []
            for text in part.column("text").to_pylist():
                base = base_spans(text)
                for c, spans in zip(counts, base):
                    c.append(len(spans))
                said = [f"{k}:{s}:{e}" for k, spans in zip(BASE, base) for s, e in spans]
                digests.append(hashlib.sha256(",".join(said).encode()).hexdigest())
                listed.append(said)
                added.append([dict(zip(("kind", "start", "end", "pattern"), c)) for c in candidates(text, base, shared.value)])
                sure.append([{"kind": k, "pattern": p, "times": n} for (k, p), n in Counter(base_patterns(text, base, shared.value)).items()])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(listed, pa.list_(pa.string())), pa.array(added, added_type), pa.array(sure, sure_type)], names=SCANNED_NAMES)

    return id_and_text(docs).mapInArrow(find, SCANNED)


#: Spans of a kind that the rates over all kinds weigh as much as.
LEAN = 50.0


def reliabilities(kinds: np.ndarray, votes: np.ndarray, counts: np.ndarray, sure: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Expectation-maximisation over distinct (kind, votes) patterns (votes of -1, 0, 1) with their counts.

    sure: which patterns are known positives; their posterior stays 1. Returns
    each pattern's posterior and, by kind, the rates of votes against, none and
    for, by class and labeler.
    """
    labelers = votes.shape[1]
    start = np.array([[[0.5, 0.3, 0.2]] * labelers, [[0.1, 0.4, 0.5]] * labelers])
    rates, prior = {int(k): start for k in np.unique(kinds)}, {int(k): 0.5 for k in np.unique(kinds)}
    posterior = np.where(sure, 1.0, 0.0)
    cast = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)  # (pattern, labeler, vote)
    for _ in range(rounds):
        logs = np.zeros((len(votes), 2))
        for k in rates:
            mine = kinds == k
            for c, p in ((0, 1 - prior[k]), (1, prior[k])):
                logs[mine, c] = np.log(p) + (cast[mine] * np.log(rates[k][c])).sum(axis=(1, 2))
        posterior = np.where(sure, 1.0, 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500))))
        weights = np.stack([counts * (1 - posterior), counts * posterior])  # (class, pattern)
        pooled = np.einsum("cp,plv->clv", weights, cast) + 1.0
        pooled /= pooled.sum(axis=2, keepdims=True)
        share = float(np.clip(weights[1][~sure].sum() / max(counts[~sure].sum(), 1), 0.01, 0.99))
        for k in rates:
            mine = kinds == k
            own = np.einsum("cp,plv->clv", weights[:, mine], cast[mine]) + LEAN * pooled
            rates[k] = own / own.sum(axis=2, keepdims=True)
            unsure = mine & ~sure
            prior[k] = float(np.clip((weights[1][unsure].sum() + LEAN * share) / (counts[unsure].sum() + LEAN), 0.01, 0.99))
    return posterior, rates


def design(kinds: np.ndarray, patterns: list[list[int]]) -> np.ndarray:
    """One column for each kind, each vote for and against, each length class, and the sign before the span."""
    p = np.asarray(patterns, dtype=np.int64).reshape(len(kinds), len(LABELERS) + 2)
    columns = [kinds == k for k in range(len(KINDS))]
    columns += [p[:, j] == v for j in range(len(LABELERS)) for v in (-1, 1)]
    columns += [p[:, len(LABELERS)] == k for k in range(4)] + [p[:, len(LABELERS) + 1] == 1]
    return np.stack(columns, axis=1).astype(np.float64)


def fit_classifier(x: np.ndarray, target: np.ndarray, counts: np.ndarray, steps: int = 30) -> np.ndarray:
    """Logistic weights (last: intercept) for soft targets with counts; Newton steps with a ridge."""
    z = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(z.shape[1]), np.eye(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (counts * (p * (1 - p) + 1e-9))[:, None]).T @ z + ridge, z.T @ (counts * (target - p)) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(scanned: DataFrame) -> dict[tuple[int, str], float]:
    """The probability that a span of each (kind, pattern) is personal data, for all patterns of candidates there are."""
    every = scanned.select(F.explode("added").alias("a")).select("a.kind", "a.pattern", F.lit(1).cast("long").alias("times"))
    every = every.unionByName(scanned.select(F.explode("sure").alias("a")).select("a.kind", "a.pattern", "a.times"))
    seen = sorted(every.groupBy("kind", "pattern").agg(F.sum("times").alias("times")).collect())  # at most kinds x votes x surfaces
    if all(r["kind"] < len(BASE) for r in seen):
        return {}
    kinds, counts = np.array([r["kind"] for r in seen]), np.array([r["times"] for r in seen], dtype=np.float64)
    parsed = [[int(v) for v in r["pattern"].split(",")] for r in seen]
    posterior, _ = reliabilities(kinds, np.array(parsed)[:, : len(LABELERS)], counts, kinds < len(BASE))
    x = design(kinds, parsed)
    w = fit_classifier(x, posterior, counts)
    p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
    return {(r["kind"], r["pattern"]): float(v) for r, v in zip(seen, p)}


def find_personal_data(docs: DataFrame, report: float = REPORT, names: frozenset[str] = FIRST_NAMES) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (base findings and added ones, by kind, then start) and n_added."""
    scanned = written(scan(docs, names), "pii-scan")
    shared = docs.sparkSession.sparkContext.broadcast({k for k, p in train(scanned).items() if p >= report})

    def said(added):
        return [f"{KINDS[a['kind']]}:{a['start']}:{a['end']}" for a in sorted(added, key=lambda a: (a["kind"], a["start"])) if (a["kind"], a["pattern"]) in shared.value]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = [said(a) for a in batch.column("added").to_pylist()]
            spans = [",".join(b + m) for b, m in zip(batch.column("base").to_pylist(), more)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")), pa.array(spans), pa.array([len(m) for m in more], pa.int64())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return scanned.mapInArrow(finish, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
