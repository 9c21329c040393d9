import hashlib

from loomline.llm import exact_dedup as X
from loomline.llm.queries import op7_exact_dedup


def want(docs):
    groups = {}
    for d, t in docs:
        groups.setdefault(t or "", []).append(d)
    out = []
    for d, t in docs:
        own = groups[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        out.append((str(d), str(keep), len(own), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect())


def test_query(spark, sf, documents):
    assert got(op7_exact_dedup(spark, sf)) == want([(r["doc_id"], r["text"]) for r in documents.collect()])


def test_edges(spark, odd_docs, no_docs, monkeypatch):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert got(X.exact_groups(odd_docs)) == want(docs)
    monkeypatch.setattr(X, "BLOCK", 7)
    assert got(X.exact_groups(odd_docs.where("doc_id is null or doc_id < 6"))) == want([d for d in docs if d[0] is None or d[0] < 6])
    assert X.exact_groups(no_docs).count() == 0


def test_names_tell_apart_what_shares_blocks(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 2)
    texts = ["", "a", "aa", "aaa", "aaaa", "aabb", "bbaa", "aaaaaa", "aaaaaaaa", "aabbaabb", "aabbaabb", "é", "aaé", "a\0", "\0a", "aabb", None, "x", None]
    docs = list(enumerate(texts)) + [(3, "aaa"), (None, "x"), (None, "zz")]
    assert got(X.exact_groups(spark.createDataFrame(docs, "doc_id long, text string"))) == want(docs)


def test_one_block_in_half_of_all_rows_and_colliding_hashes(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 4)
    monkeypatch.setattr(X, "COMMON", 5)
    # Hashes that collide choose what is common, not what is equal.
    monkeypatch.setattr(X.F, "xxhash64", lambda *c: X.F.lit(7).cast("long"))
    docs = [(i, "same" * 3 + (f"{i:04d}" if i % 2 else "")) for i in range(300)] + [(i % 3, f"own{i}") for i in range(40)] + [(2, "own2"), (2, "own5")]
    assert got(X.exact_groups(spark.createDataFrame(docs, "doc_id long, text string"))) == want(docs)
