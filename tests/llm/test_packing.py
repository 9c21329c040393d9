import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from loomline.llm import packing
from loomline.llm.queries import op2_packing, vocabulary


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary())


def holds(rows, docs, tokenizer):
    ids = defaultdict(list)
    for doc, text in docs:
        ids[doc].append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(ids)
    for doc, texts in ids.items():
        want = sorted((s, n, zlib.crc32(np.array(t[s : s + n], dtype="<u4").tobytes()), len(t)) for t in texts for s, n in spans(len(t)))
        assert sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in pieces[doc]) == want
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert sorted(sequences) == list(range(len(sequences)))
    return len(sequences)


def spans(n):
    at = 0
    for size in packing.lengths_of(n):
        yield at, size
        at += size
    assert at == n


def test_query(spark, sf, documents, tokenizer):
    rows = op2_packing(spark, sf).collect()
    n = holds(rows, [(r["doc_id"], r["text"]) for r in documents.collect()], tokenizer)
    assert sum(r["length"] for r in rows) >= 0.98 * 1024 * n


def test_edges(spark, odd_docs, no_docs, tokenizer):
    rows = packing.pack(odd_docs, vocabulary()).collect()
    holds(rows, [(r["doc_id"], r["text"]) for r in odd_docs.collect()], tokenizer)
    assert packing.pack(no_docs, vocabulary()).count() == 0


def test_ids_of_sequences(spark, odd_docs, tokenizer):
    rows = packing.pack(odd_docs, vocabulary()).collect()
    texts = Counter((r["doc_id"], (*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0)) for r in odd_docs.collect())
    want = Counter((doc, s, n, t[s : s + n]) for (doc, t), times in texts.items() for s, n in spans(len(t)) for _ in range(times))
    assert Counter((r["doc_id"], r["start"], r["length"], tuple(np.frombuffer(r["ids"], dtype="<u4").tolist())) for r in rows) == want


def test_pipeline_emits_ids(spark, documents, sf, tokenizer):
    docs = documents.limit(20)
    ids = {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    name, stage = corpus_pipeline.STAGES[-1]
    for r in stage(spark, docs, sf).collect():
        assert np.frombuffer(r["ids"], dtype="<u4").tolist() == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\xa0\u2003\x85\x1c\x00'sabé1.<|endoftext|>中"), st.characters(codec="utf-8")), max_size=40), max_size=5))
def test_ids_equal_the_library(texts):
    global _held
    try:
        _held
    except NameError:
        _held = packing.Encoder(vocabulary()), Tokenizer.from_file(vocabulary())
    enc, tok = _held
    for t, raw in zip(texts, enc.encode_all(texts)):
        assert np.frombuffer(raw, dtype="<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
