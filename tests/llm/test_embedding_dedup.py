import numpy as np

from loomline.llm import embedding_dedup as E
from loomline.llm.queries import op4_embedding_dedup


def brute(rows):
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def fine(r):
        return r[0] is not None and r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    for i in range(n):
        for j in range(i):
            a, b = rows[i], rows[j]
            if fine(a) and fine(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], dtype=float), np.array(b[1], dtype=float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted((r[0] is None, r[0] or 0, links[i], least.get(find(i))) for i, r in enumerate(rows))


def told(df):
    return sorted((r["vec_id"] is None, r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in df.collect())


def test_query_matches_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert told(op4_embedding_dedup(spark, sf)) == brute(rows)


def test_clusters(spark, monkeypatch):
    monkeypatch.setattr(E, "ENTRIES", 16)
    monkeypatch.setattr(E, "QUERIES", 16)
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(6, 16))
    rows = []
    for i in range(260):
        v = centers[i % 6] + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.15])
        rows.append((i, [float(np.float32(x)) for x in v], i % 2))
    rows += [(300 + i, rows[0][1], 0) for i in range(30)] + [(400, [2 * x for x in rows[0][1]], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert told(E.link_vectors(df)) == brute(rows)


def test_paths_over_many_slices_of_a_block(spark, monkeypatch):
    monkeypatch.setattr(E, "PAIRS", 1)
    rng = np.random.default_rng(5)
    rows = []
    for label in range(12):
        ids = rng.permutation(25) + 100 * label
        rows += [(int(i), [float(np.cos(a)), float(np.sin(a)), 0.0], label) for i, a in zip(ids, np.radians(10) * np.arange(25))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert told(E.link_vectors(df)) == brute(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [1.0, 2.0], None), (8, [1.0, 2.0], 0), (9, [2.0, 4.0], 0), (None, [1.0, 2.0], 0), (10, [1.0, 2.0, 0.0], 0), (11, [1.0, 2.0, 0.0], 0), (12, [1e300, 2e300], 1), (13, [1e-300, 2e-300], 1)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<double>, label int, id string, n int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in E.link_vectors(df).collect()}
    assert got == {**{i: (0, i, True) for i in range(1, 8)}, 8: (1, 8, True), 9: (1, 8, False), None: (0, None, True), 10: (1, 10, True), 11: (1, 10, False), 12: (1, 12, True), 13: (1, 12, False)}
    assert E.link_vectors(df.limit(0)).count() == 0
    assert E.link_vectors(df.where("vec_id < 4")).count() == 3


def brute_repeated(rows, cosine=0.98):
    """n_links and component by vec_id: links to rows of other ids, added up over an id's rows; an id's rows are one."""
    links, root = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in rows:
        for b in rows:
            x, y = np.array(a[1], dtype=float), np.array(b[1], dtype=float)
            if a[0] != b[0] and a[2] == b[2] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links[a[0]] += 1
                p, q = sorted((find(a[0]), find(b[0])))
                root[q] = p
    return {i: (links[i], find(i)) for i in links}


def test_repeated_ids(spark, monkeypatch):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.01], 0), (2, [1.0, 0.005], 0), (5, [0.0, 1.0], 0), (5, [0.0, 1.0], 1), (6, [0.0, 2.0], 0), (7, [0.0, 3.0], 1), (7, [0.0, 3.0], 1), (8, [-1.0, 0.1], 2), (8, [-1.0, 0.1], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.link_vectors(df).collect()}
    assert got == brute_repeated(rows) and got[1][0] == 2 and got[8] == (0, 8)
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(5, 8))
    rows = [(int(rng.integers(60)), [float(x) for x in centers[i % 5] + 0.08 * rng.normal(size=8)], int(rng.integers(3))) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(E, "MOST_BROADCAST", 0)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.link_vectors(df).collect()} == brute_repeated(rows)


def test_lists_of_several_lengths(spark, monkeypatch):
    """Each pair is met once, whichever list probes; lengths with and without an index."""
    monkeypatch.setattr(E, "INDEXED", 2)
    rng = np.random.default_rng(7)
    rows = []
    for dim, n in ((6, 900), (5, 300), (3, 60)):
        centers = rng.normal(size=(12, dim))
        rows += [(len(rows) + i, [float(x) for x in centers[i % 12] + 0.1 * rng.normal(size=dim)], 0) for i in range(n)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert told(E.link_vectors(df)) == brute(rows)
