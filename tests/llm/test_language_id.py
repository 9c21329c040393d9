import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from loomline.llm import language_id as L
from loomline.llm.queries import op5_language_id


def slow_bits(samples, text):
    """Code length from counts in dictionaries, one byte at a time. Bytes that no sample holds are one symbol."""
    seen = {b for texts in samples.values() for t in texts for b in t}
    fold = lambda t: [b if b in seen else -1 for b in t]
    lead = fold(b"\n" * L.ORDER)
    out = {}
    for lang, texts in samples.items():
        s = list(lead)
        for t in texts:
            s += fold(t) + lead
        counts = defaultdict(Counter)
        for i in range(L.ORDER, len(s)):
            for k in range(L.ORDER + 1):
                counts[tuple(s[i - k : i])][s[i]] += 1
        bits, x = 0.0, lead + fold(text)
        for i in range(L.ORDER, len(x)):
            p = 1.0
            for k in range(L.ORDER, -1, -1):
                c = counts.get(tuple(x[i - k : i]))
                if c:
                    t, q = sum(c.values()), len(c)
                    if c[x[i]]:
                        p *= c[x[i]] / (t + q)
                        break
                    p *= q / (t + q)
            else:
                p /= 256
            bits -= math.log2(p)
        out[lang] = bits
    return out


def test_code_lengths_match_brute_force():
    samples = {"a": [b"abracadabra zzz", b"banana\nband"], "b": ["schön über öl".encode(), b"abc"], "c": [b"x"]}
    texts = ["abrakadabra über q".encode(), b"banana", "öööx".encode(), b"\x00\xff!", b""]
    got = L.Model(samples).bits(texts)
    for t, row in zip(texts, got):
        want = slow_bits(samples, t)
        assert np.allclose(row, [want[x] for x in ("a", "b", "c")], rtol=1e-5)


def test_query_accuracy(spark, sf, documents):
    rows = op5_language_id(spark, sf).collect()
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in documents.collect()}
    assert len(rows) == len(truth)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        text = truth[r["doc_id"]][1]
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
    held = [r for r in rows if r["held_out"] and truth[r["doc_id"]][0] and r["lang_pred"] != "und"]
    assert held and sum(truth[r["doc_id"]][0] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_held_out_rows_are_not_learned_from(spark, documents):
    changed = documents.withColumn("lang", F.when(L.remainder(F.col("doc_id")) == 2, F.lit("xx")).otherwise(F.col("lang")))
    assert "xx" not in L.fit(changed).langs


def test_edges(spark, odd_docs, no_docs):
    got = {r["doc_id"]: r["lang_pred"] for r in L.identify(odd_docs).collect()}
    assert [got[i] for i in (1, 2, 3, 9)] == ["und"] * 4 and got[6] != "und"
    assert L.identify(odd_docs).count() == odd_docs.count()
    assert L.identify(no_docs).count() == 0
    assert {r["lang_pred"] for r in L.identify(odd_docs, L.Model({})).collect()} == {"und"}


def test_query_matches_slow_bits(spark, documents):
    """Predictions and scores of the query's rows are those of code lengths counted in dictionaries."""
    docs = documents.limit(60)
    samples = {}
    for r in L.sample_of(documents, 4, 300).collect():
        samples.setdefault(r["lang"], []).append(bytes(r["text"]))
    got = {r["doc_id"]: r for r in L.identify(docs, L.fit(documents, 4, 300)).collect()}
    for r in docs.collect():
        if got[r["doc_id"]]["lang_pred"] == "und":
            continue
        bits = slow_bits(samples, r["text"].encode()[:10**6])
        assert bits[got[r["doc_id"]]["lang_pred"]] <= min(bits.values()) + 1e-3 * len(r["text"])
        score = 1 / sum(2.0 ** max(-1000, min(bits.values()) - b) for b in bits.values())
        assert abs(got[r["doc_id"]]["score"] - score) < 0.05


def test_sample_is_bounded_for_repeated_ids(spark):
    rows = spark.createDataFrame([(1, f"text number {i}", "en") for i in range(2000)], "doc_id long, text string, lang string")
    assert L.sample_of(rows, 300, 1000).count() == 300


def test_languages_of_long_texts_only_are_learned(spark):
    rows = spark.createDataFrame([(i, "wort " * 500 if i < 9 else "word " * 3, "de" if i < 9 else "en") for i in range(20)], "doc_id long, text string, lang string")
    assert L.fit(rows, 300, 100).langs == ["de", "en"]


def test_model_takes_room_for_what_it_knows():
    rng = np.random.default_rng(2)
    samples = {f"l{k}": [bytes(rng.integers(32, 255, 200).astype(np.uint8)) for _ in range(20)] for k in range(60)}
    model = L.Model(samples)
    held = sum(x.nbytes for r in (model.triple, model.leave, model.quad) for x in (r.keys, r.ends, r.lang, r.value))
    assert held < 60 * 20 * 206 * 3 * 40 and model.pair.nbytes + model.escape.nbytes <= 60 * (1 << 19)


def test_searched_tables_give_the_same(monkeypatch):
    samples = {"a": [b"abracadabra zzz", b"banana band"], "b": ["schön über öl".encode(), b"abc"], "c": [b"x"]}
    texts = ["abrakadabra über q".encode(), b"banana", b"", b"\x00\xff!"]
    want = L.Model(samples).bits(texts)
    monkeypatch.setattr(L, "MOST_CELLS", 0)
    monkeypatch.setattr(L, "_BYTES", 7)
    assert np.allclose(L.Model(samples).bits(texts), want)
