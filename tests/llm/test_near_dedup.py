import math
import random
import re
from collections import Counter

import numpy as np

from loomline.llm import near_dedup as N
from loomline.llm.common import components
from loomline.llm.queries import op3_near_dedup


def classes(docs, idf):
    """Brute force over all pairs, with shingles as tuples of words."""
    items = []
    for _, text in docs:
        (s, c), = N.shingles_of([text.encode() if text else None])
        items.append((s, c * idf[N.bucket_of(s)]))
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if N.weighted_jaccard(items[i], items[j]) >= 0.8:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(docs)}


def test_query_matches_brute_force(spark, sf, documents):
    docs = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    want = classes(docs, N.idf_table(documents))
    got = {r["doc_id"]: (r["class_id"], r["kept"]) for r in op3_near_dedup(spark, sf).collect()}
    assert got == {d: (c, d == c) for d, c in want.items()}


def test_large_groups(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(5000)}" for _ in range(120)] for _ in range(3)]
    docs = []
    for g, words in enumerate(base):
        for i in range(60):
            w = list(words)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            docs.append((1000 * g + i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(df).collect()}
    assert got == classes(docs, N.idf_table(df))


def test_samples_agree_as_often_as_weighted_jaccard():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64))
    idf = rng.uniform(1, 6, N.DF_BUCKETS)
    a, b = (x[:300], np.full(300, 1)), (x[60:], rng.integers(1, 3, len(x) - 60))
    rows = N.sample([a, b], idf, 4000)
    want = N.weighted_jaccard(*[(s, c * idf[N.bucket_of(s)]) for s, c in (a, b)])
    assert abs((rows[0] == rows[1]).mean() - want) < 0.03


def test_edges(spark, odd_docs, no_docs):
    got = {}
    for r in N.near_duplicates(odd_docs).collect():
        got.setdefault(r["doc_id"], set()).add((r["class_id"], r["kept"]))
    assert got[1] == {(1, True)} and got[2] == {(2, True)} and got[3] == {(3, True)} and got[None] == {(None, True)}
    assert got[4] == {(4, True)} and got[5] == {(4, False)}
    assert got[6] == {(6, True)} and got[7] == {(6, False)} and got[8] == {(6, False)}
    assert N.near_duplicates(no_docs).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (None, 3)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root}


def test_blocks_find_what_brute_force_finds(spark, monkeypatch):
    """Links between classes of one bucket, cut into many blocks."""
    import numpy as np

    from loomline.llm import near_dedup as N

    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(14):
        words = list(base)
        for p in rng.choice(80, i % 4, replace=False):
            words[p] = f"x{i}_{p}"
        texts.append((i, " ".join(words)))
    idf = np.ones(N.DF_BUCKETS)
    frame = spark.createDataFrame(texts, "id long, text string").selectExpr("id", "cast(text as binary) as text")
    rows = spark.createDataFrame([(7, 0, i, i // 2, len(t)) for i, t in texts], "key long, sub long, id long, class long, bytes long")
    cells = spark.createDataFrame([(7, 0, 0, 14, 14 * 400, 12, 12 * 400)], "key long, sub long, home long, n long, size long, strays long, stray_size long")
    shared = spark.sparkContext.broadcast(idf)
    got = N.shingles_of([t.encode() for _, t in texts])
    weighed = [(k, n.astype(float)) for k, n in got]
    linked = {(a, b // 2) for a in range(2, 14) for b in range(14) if a // 2 != b // 2 and N.weighted_jaccard(weighed[a], weighed[b]) >= 0.8}
    assert linked and len(linked) < 12 * 7
    monkeypatch.setattr(N, "BLOCK_ROWS", 3)
    found = {(r.a, r.b // 2) for r in N.links_across(rows, cells, frame, 0.8, shared).collect()}
    assert found == linked


def plain_similarities(texts):
    """Weighted Jaccard similarity of all pairs from tuples of words and exact document frequencies, without the operator's code."""
    bags = []
    for t in texts:
        w = re.findall(r"[^ \t\n\v\f\r]+", t or "")
        bags.append(Counter([tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []))
    df = Counter(s for b in bags for s in b)
    idf = {s: 1 + min(1, math.log((len(texts) + 1) / (n + 1)) / math.log(1024)) for s, n in df.items()}
    weight = [sum(n * idf[s] for s, n in b.items()) for b in bags]
    where = {}
    for i, b in enumerate(bags):
        for s in b:
            where.setdefault(s, []).append(i)
    for i, b in enumerate(bags):
        low = Counter()
        for s, n in b.items():
            for j in where[s]:
                if j < i:
                    low[j] += min(n, bags[j][s]) * idf[s]
        for j, x in low.items():
            yield i, j, x / (weight[i] + weight[j] - x)


def test_independent_brute_force(spark, documents):
    """Recall of pairs that are safely similar is 1, and no class is held together by pairs that are safely not."""
    docs = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(documents).collect()}
    pairs = list(plain_similarities([t for _, t in docs]))
    sure = [(i, j) for i, j, s in pairs if s >= 0.81]
    assert sure and all(got[docs[i][0]] == got[docs[j][0]] for i, j in sure)
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j, s in pairs:
        if s >= 0.79:
            root[find(i)] = find(j)
    joined = {}
    for i, (d, _) in enumerate(docs):
        joined.setdefault(got[d], set()).add(find(i))
    assert all(len(x) == 1 for x in joined.values())


def test_shared_template_costs_about_linear_work(spark, monkeypatch):
    """Pages of one template with words of their own meet in buckets; the comparisons there must not grow with the square."""
    rng = random.Random(11)
    template = " ".join(f"t{rng.randrange(9999)}" for _ in range(200))
    monkeypatch.setattr(N, "BLOCK_ROWS", 64)
    work = []
    for n in (500, 2000):
        texts = spark.createDataFrame([(i, f"{template} " + " ".join(f"o{rng.randrange(10**7)}" for _ in range(100))) for i in range(n)], "id long, text string")
        texts = texts.selectExpr("id", "cast(text as binary) as text")
        shared = spark.sparkContext.broadcast(N.idf_table(texts))
        rows = texts.selectExpr("7L as key", "0L as sub", "id", "id as class", "cast(octet_length(text) as long) as bytes")
        rows, cells = N.narrowed(rows, N._cells(rows), texts, 0.8, shared)
        work.append(sum(r["n"] * r["strays"] for r in cells.collect()))
    assert work[0] < 500 * 499 / 20 and work[1] <= 8 * max(work[0], 500)


def test_narrowed_cells_lose_no_link(spark, monkeypatch):
    rng = random.Random(4)
    template = [f"t{rng.randrange(9999)}" for _ in range(60)]
    docs = []
    for i in range(150):
        own = [f"o{rng.randrange(10**6)}" for _ in range(60)] if i % 3 else docs[-1][1].split()[60:] if docs else ["x"] * 60
        words = template + own
        for _ in range(rng.randrange(3)):
            words[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = classes(docs, N.idf_table(df))
    monkeypatch.setattr(N, "BLOCK_ROWS", 8)
    monkeypatch.setattr(N, "ROWS", 1)  # wide buckets
    assert {r["doc_id"]: r["class_id"] for r in N.near_duplicates(df).collect()} == want


def test_near_copies_in_a_group_of_a_third_of_all(spark):
    """Copies of one text with two words changed in each stay one class, however many there are."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(260)]
    docs = []
    for i in range(300):
        words = list(base) if i % 3 == 0 else [f"w{rng.randrange(5000)}" for _ in range(260)]
        if i % 3 == 0 and i:
            for _ in range(2):
                words[rng.randrange(260)] = f"e{rng.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[i] == (0 if i % 3 == 0 else i) for i in range(300))


def test_texts_of_one_id_and_length_are_told_apart(spark):
    a, b = " ".join(f"a{i:03}" for i in range(60)), " ".join(f"b{i:03}" for i in range(60))
    rows = [(1, a), (1, b), (2, b + " end"), (3, a + " end"), (4, "else " * 9)]
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}
