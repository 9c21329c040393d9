import hashlib
import random

import numpy as np

from loomline.llm import substring_dedup as B
from loomline.llm.common import spelled, words_of
from loomline.llm.queries import op10_substring_dedup


def want(docs, n=13):
    split = [(t or "").encode().split() for _, t in docs]
    least = {}
    for (d, _), w in zip(docs, split):
        if d is not None:
            for i in range(len(w) - n + 1):
                k = tuple(w[i : i + n])
                least[k] = min(least.get(k, d), d)
    out = []
    for (d, _), w in zip(docs, split):
        gone = set()
        if d is not None:
            for i in range(len(w) - n + 1):
                if least[tuple(w[i : i + n])] < d:
                    gone.update(range(i, i + n))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(d), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect())


def test_query(spark, sf, documents):
    assert got(op10_substring_dedup(spark, sf)) == want([(r["doc_id"], r["text"]) for r in documents.collect()])


def test_shared_passages(spark, monkeypatch):
    monkeypatch.setattr(B, "HELD", 20_000)
    rng = random.Random(8)
    word = lambda: rng.choice(["a", "b", "c", "é", "word"]) if rng.random() < 0.3 else f"w{rng.randrange(10**6)}"
    passages = [[word() for _ in range(rng.choice([13, 14, 40, 90]))] for _ in range(8)]
    docs = []
    for i in range(250):
        w = [word() for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            w += p[rng.randrange(3) :] + [word() for _ in range(rng.randrange(20))]
        docs.append((i, " ".join(w)))
    docs += [(i, "same " * 30) for i in range(500, 510)]
    assert got(B.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))) == want(docs)


def test_hot_minimisers_and_strings_of_many_places(spark, monkeypatch):
    """A common phrase in ever other words, a common passage, and repeated ids, with every class hot and strings told apart early."""
    monkeypatch.setattr(B, "MANY", 3)
    monkeypatch.setattr(B, "HOT", 0.0005)
    monkeypatch.setattr(B, "CELLS", 640)
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(400)}"
    line, phrase = [word() for _ in range(30)], ["the", "common", "words"]
    docs = []
    for i in range(300):
        w = [word() for _ in range(rng.randrange(20))]
        for _ in range(3):
            w += phrase + [word() for _ in range(rng.randrange(9))]
        if i % 3 == 0:
            w += line
        docs.append((i, " ".join(w + [word()])))
    docs += [(17, " ".join(line + ["again"])), (17, docs[20][1]), (None, " ".join(line))]
    assert got(B.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(2))) == want(docs)


def test_a_hot_string_sends_one_place_to_its_bucket():
    import pyarrow as pa

    text = " ".join(f"w{i}" for i in range(20)).encode()
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([0] * 1000), pa.array([text] * 1000)], ["doc_id", "row", "text"])
    sent = list(B.send(iter([batch]), 64, np.zeros(B.CLASSES, dtype=bool)))
    blobs = [b for x in sent for b in x.column(1).to_pylist() if b]
    assert all(B._unpack(b)[1].tolist() == [1] * len(B._unpack(b)[1]) and B._unpack(b)[3].all() for b in blobs)
    assert sum(1 for x in sent for p in x.column(3).to_pylist() if p) == sum(len(B._unpack(b)[1]) for b in blobs)


def test_super_k_mers_cover_each_window_once():
    rng = np.random.default_rng(0)
    owner = np.repeat(np.arange(40), rng.integers(0, 60, 40))
    hashes = rng.integers(0, 50, len(owner)).astype(np.uint64)
    first, last, _ = B.runs(hashes, owner)
    windows = [i for a, z in zip(first, last) for i in range(a, z + 1)]
    assert windows == [i for i in range(len(owner) - 12) if owner[i] == owner[i + 12]]


def test_colliding_codes_are_told_apart(monkeypatch):
    import zstandard

    monkeypatch.setattr(B, "spelled", lambda buf, start, stop: np.zeros(len(start), dtype=np.uint64))
    s = [" ".join(f"{p}{i}" for i in range(15)).encode() for p in "abab"]
    blob = B._pack(s, np.ones(4), np.array([[0, 1, 2, 3], [0] * 4, [0] * 4]), zstandard.ZstdCompressor())
    ids, _, start, end = B.settle([blob])
    assert sorted(zip(ids.tolist(), start.tolist(), end.tolist())) == [(2, 0, 15), (3, 0, 15)]


def test_edges(spark, odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert got(B.remove_repeats(odd_docs)) == want(docs)
    assert B.remove_repeats(no_docs).count() == 0


def test_words_and_their_hashes():
    texts = [None, b"", b" \x0b", "ab\u00e9  cd\tab\u00e9\x1c".encode(), b"\n\nx\n", b"cd", b"a" * 5000]
    buf, start, stop, sizes = words_of(texts)
    want = [(t or b"").split() for t in texts]
    assert sizes.tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    assert [buf[a:z].tobytes() for a, z in zip(start, stop)] == flat and buf.tobytes() == b" ".join([*flat, b""])
    codes = spelled(buf, start, stop).tolist()
    assert len(set(codes)) == len(set(flat)) and codes[1] == codes[4]
    other, a, z, _ = words_of([b"x cd"])
    assert spelled(other, a, z)[1] == codes[1]
    assert [len(x) for x in words_of([])] == [0] * 4
