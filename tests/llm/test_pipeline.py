from collections import Counter

import corpus_pipeline as P
from loomline.llm import mixing, near_dedup
from loomline.llm.common import save
from tests.llm.test_near_dedup import classes


def test_each_stage_against_brute_force(spark, sf, documents):
    docs, seen = documents, {}
    for name, stage in P.STAGES:
        before = [r.asDict() for r in docs.collect()]
        out = save(stage(spark, docs, sf))
        after = [r.asDict() for r in out.collect()]
        key = lambda r: tuple(sorted(r.items(), key=lambda x: x[0]))
        if name != "packing":
            assert out.columns == documents.columns
        if name == "language_id":
            assert Counter(map(key, after)) == Counter(key(r) for r in before if any(c.isalpha() for c in r["text"] or ""))
        if name == "exact_dedup":
            last = {}
            for r in before:
                last[r["text"] or ""] = max(last.get(r["text"] or "", -1), r["doc_id"])
            assert {r["doc_id"] for r in after} == set(last.values())
        if name == "near_dedup":
            want = classes([(r["doc_id"], r["text"]) for r in before], near_dedup.idf_table(docs))
            assert {r["doc_id"] for r in after} == {d for d, c in want.items() if d == c}
        if name == "mixing":
            copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
            assert Counter(r["doc_id"] for r in after) == Counter({d: n for d, n in copies.items() if n})
        if name == "packing":
            held = Counter()
            for r in after:
                held[r["sequence_id"]] += r["length"]
            tokens = {r["doc_id"]: r["doc_tokens"] for r in after}
            assert max(held.values()) <= 1024
            assert sum(held.values()) == sum(tokens[r["doc_id"]] for r in before)
        seen[name], docs = len(after), out
    assert seen["packing"] > 0
    assert P.run(spark, sf).count() == seen["packing"]


def test_stages_on_odd_rows(spark, sf, odd_docs, no_docs):
    """Nulls, empty and long texts, repeated rows, clashing names, an empty table, stage by stage."""
    from pyspark.sql import functions as F

    docs = odd_docs
    for c in ("lang_pred", "_lang_pred", "text_sha256", "number", "none", "copies", "rate", "seed", "l", "r", "class_id", "row_hash"):
        docs = docs.withColumn(c, F.lit("clash"))
    stages = dict(P.STAGES)
    for name in ("language_id", "exact_dedup", "near_dedup", "mixing"):
        out = save(stages[name](spark, docs, sf))
        assert out.columns == docs.columns
        none = stages[name](spark, no_docs, sf)
        assert none.count() == 0 and none.columns == no_docs.columns
        if name == "language_id":
            assert {r["doc_id"] for r in out.collect()} == {None, 4, 5, 6, 7, 8, 10}
            assert out.where("doc_id = 4").count() == 2
        if name == "exact_dedup":
            assert sorted(r["doc_id"] for r in out.collect()) == [2, 3, 5, 7, 8, 9, 10]
            again = stages[name](spark, docs.where("doc_id = 4"), sf)
            assert [r["doc_id"] for r in again.collect()] == [4]
        if name == "near_dedup":
            assert {r["doc_id"] for r in out.collect()} == {None, 1, 2, 3, 4, 6, 9, 10}
    pieces = stages["packing"](spark, docs, sf).collect()
    assert {r["doc_id"] for r in pieces} == {None, *range(1, 11)}
    assert stages["packing"](spark, no_docs, sf).count() == 0
