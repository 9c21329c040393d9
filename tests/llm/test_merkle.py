import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from loomline.llm import merkle as M
from loomline.llm.queries import op11_merkle_manifest
from loomline.operators import segments

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, text):
    values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def up(nodes):
    """The root over nodes, and by node the runs on its way: (place, run)."""
    paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, under = [], []
        for at in range(0, len(nodes), 8):
            run = nodes[at : at + 8]
            for k in range(len(run)):
                for i in owners[at + k]:
                    paths[i].append((k, run))
            above.append(sha(*run))
            under.append([i for o in owners[at : at + 8] for i in o])
        nodes, owners = above, under
    return nodes[0], paths


def want(rows):
    """Level by level over lists, another way than by recursion over blocks."""
    langs = {}
    for r in rows:
        langs.setdefault(r["lang"], []).append(r)
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    sub = {}
    for name in names:
        own = sorted(langs[name], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"])))
        sub[name] = (own, *up([leaf_of(r, r["text"]) for r in own]))
    root, over = up([sub[name][1] for name in names]) if names else (None, [])
    out = []
    for name, more in zip(names, over):
        own, subroot, paths = sub[name]
        for r, path in zip(own, paths):
            text = r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node, others = leaf_of(r, text), []
            for k, run in path + more:
                others += run[:k] + run[k + 1 :]
                node = sha(*run[:k], node, *run[k + 1 :])
            out.append((r["doc_id"], leaf_of(r, r["text"]), subroot, root, sha(*others), node, node == root))
    return sorted(map(str, out))


def got(df):
    return sorted(str(tuple(r[c] for c in COLUMNS)) for r in df.collect())


def test_query(spark, sf, documents):
    df = op11_merkle_manifest(spark, sf)
    assert df.columns == COLUMNS
    assert got(df) == want(documents.collect())
    told = {r["verified"]: r["n"] for r in df.groupBy("verified").agg(F.count("*").alias("n")).collect()}
    assert told[False] > 20 and told[True] > 20


@pytest.mark.parametrize("levels,least", [(1, 3), (2, 10), (4, 1 << 16)])
def test_blocks_and_ranges(spark, documents, odd_docs, no_docs, monkeypatch, levels, least):
    monkeypatch.setattr(M, "LEVELS", levels)
    monkeypatch.setattr(segments, "LEAST", least)
    for docs in (documents, odd_docs, odd_docs.union(odd_docs), odd_docs.where("lang = 'fr'"), odd_docs.where("doc_id = 6")):
        assert got(M.verify_tampered(docs)) == want(docs.collect())
    assert M.verify_tampered(no_docs).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 511, 512, 513, 4097])
def test_traverse(n):
    nodes = [sha(str(i)) for i in range(n)]
    root, steps = M.traverse(nodes, M.levels_of(n))
    other, paths = up(nodes)
    assert root == other
    assert steps == [[("".join(run[:k]), "".join(run[k + 1 :])) for k, run in path] for path in paths]


def test_many_groups(spark):
    rows = [(i, None, f"l{i % 70}" if i % 71 else None, i, "Text") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert got(M.verify_tampered(docs)) == want(docs.collect())


def test_any_change_shows(spark, documents):
    rows = M.manifest(documents)
    folded = rows.select("root", M.fold(F.col("leaf"), F.col("proof")).alias("ok"), M.fold(F.sha2(F.col("leaf"), 256), F.col("proof")).alias("bad"))
    assert folded.where("ok <> root or bad = root").count() == 0
