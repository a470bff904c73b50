import hashlib
import random

from graphloom.llm import bpe


def texts():
    rng = random.Random(3)
    letters = "ab 'ré\n\t 12!?中文  "
    out = [None, "", " ", "a", "don't  stop\n\n\nnow", "x" * 700, " " * 500 + "y", "it's" * 200, "<|endoftext|>"]
    out += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 900))) for _ in range(60)]
    out += [" ".join(rng.choice(["the", "onre", "ándo", "12", "can't", "\n\n"]) for _ in range(400)) for _ in range(20)]
    return out


def test_chunks_give_the_ids_of_whole_texts(make_docs):
    rows = list(enumerate(texts()))
    path = bpe.default_ranks_path()
    encoding = bpe.codec(path)[0]
    for chunk, overlap in ((128, 48), (32_768, 1_024)):
        got = {r.doc_id: r for r in bpe.round_trip_digests(make_docs(rows, ["row_key", "ids"]), path, chunk, overlap).collect()}
        assert len(got) == len(rows)
        for i, t in rows:
            ids = encoding.encode_ordinary(t or "")
            assert got[i].n_tokens == len(ids)
            assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), (chunk, t)
            assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_encode_then_decode(make_docs):
    rows = list(enumerate(texts())) + [(None, "no id"), (1, "")]
    encoded = bpe.encode_documents(make_docs(rows), chunk_chars=128, overlap_chars=48)
    data = bpe.decode_documents(encoded).collect()
    assert sorted(bytes(r.data) for r in data) == sorted((t or "").encode() for _, t in rows)


def test_empty_table(make_docs):
    assert bpe.round_trip_digests(make_docs([])).count() == 0


def test_long_texts_are_cut_in_several_pieces():
    text = " ".join(["onre thti"] * 400)
    chunks = [(b, text[b : b + 256]) for b in range(0, len(text) - 64, 192)]
    seams = []
    for b, c in chunks:
        safe = bpe.safe_boundaries(c, b, b + len(c) >= len(text), b, b + len(c))
        seams.append((b, [x for x in safe if b < x < b + 64], [x for x in safe if x > b + 192]))
    assert len(bpe.piece_starts(seams)) == len(chunks)


def test_texts_beyond_the_default_chunk(make_docs):
    rng = random.Random(6)
    words = ["the", "onre", "ándo", "12", "can't", "\n\n", "中文", "  "]
    rows = [(1, " ".join(rng.choice(words) for _ in range(30_000))), (2, "x" * 80_000), (2, "x" * 80_000), (3, " " * 70_000 + "y"), (None, "a1 " * 40_000)]
    encoding = bpe.codec(bpe.default_ranks_path())[0]
    got = sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip_digests(make_docs(rows)).collect())
    want = []
    for _, t in rows:
        ids = encoding.encode_ordinary(t)
        want.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want)
