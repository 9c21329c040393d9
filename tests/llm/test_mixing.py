import re

from loomline.llm import mixing as M
from loomline.llm.queries import op8_mixing


def goals(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, capped = float(sum(sizes.values())), {}
    while True:
        free = [s for s in order if s not in capped]
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        for s in over:
            capped[s] = 3.0 * sizes[s]
            left -= capped[s]


def holds(rows, docs, near):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + count(t)
    goal = goals(sizes)
    assert sorted((str(r["doc_id"]), r["size"]) for r in rows) == sorted((str(d), count(t)) for d, t, _ in docs)
    taken = {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - goal[r["source"]]) <= 1e-6 * max(1, goal[r["source"]])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    if near:
        for s, g in goal.items():
            assert abs(taken[s] - g) <= near * g
    return taken


def test_query(spark, sf, documents):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in documents.collect()]
    holds(M.mix(documents).collect(), docs, 0.25)
    one, two = (sorted(op8_mixing(spark, sf).collect()) for _ in range(2))
    assert one == two


def test_large_sources_come_close(spark):
    docs = [(i, "w " * (i % 50 + 1), "abc"[i % 3] if i % 7 else None) for i in range(4000)] + [(9999, "w w", "tiny")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    holds(M.mix(df).collect(), docs, 0.01)
    emitted = M.emit(df).groupBy("doc_id").count().collect()
    copies = {r["doc_id"]: r["copies"] for r in M.mix(df).collect() if r["copies"]}
    assert {r["doc_id"]: r["count"] for r in emitted} == copies


def test_edges(spark, odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in odd_docs.collect()]
    rows = M.mix(odd_docs).collect()
    holds(rows, docs, None)
    assert M.emit(odd_docs).columns == odd_docs.columns
    assert M.mix(no_docs).count() == 0 and M.emit(no_docs).count() == 0


def test_choosing_a_seed_keeps_the_probability(spark):
    """Over many sources a document is drawn as often as the fraction asks for, and each source comes close to its target."""
    rows = [(i * 40 + k, "one two three four five " * (1 + k % 3), f"s{i:03}") for i in range(120) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    drawn, wanted, off = [0, 0], [0.0, 0.0], []
    by_source = {}
    for r in M.mix(df).collect():
        rate = r["target"] / r["source_size"]
        half = r["doc_id"] % 40 >= 20  # no half of a source is preferred
        drawn[half] += r["copies"] - int(rate)
        wanted[half] += rate - int(rate)
        s = by_source.setdefault(r["source"], [0, r["target"]])
        s[0] += r["taken"]
    for got, want in zip(drawn, wanted):
        assert abs(got - want) < 0.03 * 2400
    off = [abs(t - g) / g for t, g in by_source.values()]
    assert max(off) < 0.05 and sum(off) / len(off) < 0.01
