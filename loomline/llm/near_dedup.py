"""Near-duplicate documents: consistent weighted sampling over TF-IDF shingles, banded and verified.

Shingles are SHINGLE consecutive words, weighted by their count times an inverse document frequency.
Document frequencies are counted over all documents in DF_BUCKETS hash buckets, which bounds
their size and keeps their relative noise the same at every corpus size. The inverse frequencies run from 1 to 2, so
that what a large group of copies has in common keeps its weight. Improved consistent
weighted sampling gives BANDS x ROWS samples a text; two texts agree on one with the
probability of their weighted Jaccard similarity. Texts that agree on a whole band become
candidates, and the similarity of a candidate pair is computed exactly.

Pairs are never expanded within a bucket. Each text is first compared with the smallest text of its
buckets, then with the smallest of each bucket where it isn't yet known to be of one class with it. Where a
bucket still holds several classes, the members outside its largest class are compared with all members of other
classes, block by block. Of buckets above a block, only those pairs are compared that share one of the rare shingles
without which a text can't reach the similarity (prefix filtering), where that makes fewer comparisons. No link that
joins two classes is lost among the candidates, while a bucket of copies costs one comparison a member and a bucket of
pages that share a template next to none.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, discard, hot_join, mix, save, slices, spelled, words_of

SHINGLE, SIMILARITY = 5, 0.8
#: A pair at the least similarity is missed with probability (1 - 0.8^ROWS)^BANDS, under 0.001.
BANDS, ROWS = 10, 3
DF_BUCKETS = 1 << 17
#: Frequencies in which a shingle's weight falls from 2 to 1: those from 1 / RANGE of the documents to all.
RANGE = 1024
#: Rows and bytes of text of a block.
BLOCK_ROWS, BLOCK_BYTES = 1024, 8 << 20
#: Parts into which the texts that are compared with one leader are dealt.
SLOTS = 256
_SEED = 0x5851F42D4C957F2D


def shingles_of(texts: list[bytes | None], n: int = SHINGLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct shingle hashes of each text and their counts. Fewer than n words are one shingle."""
    buf, start, stop, sizes = words_of(texts)
    flat = mix(spelled(buf, start, stop))
    if len(flat) >= n:
        acc = flat[: len(flat) - n + 1].copy()
        for k in range(1, n):
            acc = acc * np.uint64(0x9E3779B97F4A7C15) + flat[k : len(flat) - n + 1 + k]
        acc = mix(acc)
    out, at = [], 0
    for m in sizes.tolist():
        if m >= n:
            out.append(_distinct(acc[at : at + m - n + 1]))
        elif m:
            out.append((mix(spelled(buf, start[at : at + 1], stop[at + m - 1 : at + m])), np.array([1])))
        else:
            out.append((np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)))
        at += m
    return out


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers and their counts."""
    x = np.sort(x)
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[first], np.diff(first, append=len(x))


def bucket_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - 17)).astype(np.int64)


def frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Numbers of the texts that hold a shingle of each bucket, and of all texts. DF_BUCKETS numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DF_BUCKETS, dtype=np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for part in slices(batch, 0):
                got = shingles_of(part.column(0).to_pylist())
                df += np.bincount(bucket_of(np.concatenate([s for s, _ in got])), minlength=DF_BUCKETS)
        full = np.flatnonzero(df)
        for at in range(0, len(full), 50_000):
            part = full[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(df[part])], ["bucket", "df"])
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([n])], ["bucket", "df"])

    counted = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "bucket long, df long")
    table = counted.groupBy("bucket").agg(F.sum("df").alias("df")).toArrow()
    bucket, df = table.column("bucket").to_numpy(), table.column("df").to_numpy()
    counts = np.zeros(DF_BUCKETS, dtype=np.int64)
    counts[bucket[bucket >= 0]] = df[bucket >= 0]
    return counts, int(df[bucket == -1].sum())


def idf_table(docs: DataFrame) -> np.ndarray:
    """Inverse document frequencies by bucket, from 1 to 2, over all documents."""
    counts, total = frequencies(docs)
    return 1 + np.clip(np.log((total + 1) / (counts + 1)) / np.log(RANGE), 0, 1)


@functools.cache
def _gamma() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1) at 2^16 even steps, and their inverses."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    x = np.linspace(0, 30, 1 << 20)
    r = np.interp(p, 1 - np.exp(-x) * (1 + x), x).astype(np.float32)
    return r, (1 / r).astype(np.float32)


def sample(items: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, samples: int = BANDS * ROWS) -> np.ndarray:
    """Consistent weighted samples, a row per document with shingles, as 64-bit hashes of (shingle, level)."""
    x = np.concatenate([s for s, _ in items])
    sizes = np.array([len(s) for s, _ in items])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(items)), sizes)
    logs = np.log(np.concatenate([c for _, c in items]) * idf[bucket_of(x)]).astype(np.float32)
    gamma, inverse = _gamma()
    out = np.empty((len(items), samples), dtype=np.uint64)
    low = np.uint64(0xFFFF)
    for k in range(samples):
        z = mix(x ^ np.uint64((_SEED * (2 * k + 1)) % (1 << 64)))
        pick = (z & low).astype(np.int32)
        beta = ((z >> np.uint64(16)) & low).astype(np.float32) * np.float32(1 / 65536)
        u = (((z >> np.uint64(32)) & low).astype(np.float32) + np.float32(0.5)) * ((z >> np.uint64(48)).astype(np.float32) + np.float32(0.5))
        r = gamma[pick]
        level = np.floor(logs * inverse[pick] + beta)
        score = np.log(-np.log(u * np.float32(2**-32))) - r * (level - beta + np.float32(1))
        least = np.minimum.reduceat(score, starts)
        hit = np.flatnonzero(score == least[owner])
        first = hit[np.concatenate([[True], owner[hit][1:] != owner[hit][:-1]])]
        out[:, k] = mix(x[first] + mix(level[first].astype(np.int64).astype(np.uint64) + np.uint64(k)))
    return out


def _digest() -> Column:
    """16 bytes by which texts are told apart."""
    return F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, 16).alias("same")


def signatures(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """``(doc_id, same, bytes, keys)`` of the documents with words: a digest of the text, its length, a key for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        for batch in batches:
            for part in slices(batch, 2):
                texts = part.column(2).to_pylist()
                got = shingles_of(texts)
                full = [i for i, (s, _) in enumerate(got) if len(s)]
                if not full:
                    continue
                rows = sample([got[i] for i in full], idf, BANDS * ROWS).reshape(len(full), BANDS, ROWS)
                key = mix(rows[:, :, 0] + np.arange(BANDS, dtype=np.uint64))
                for k in range(1, ROWS):
                    key = mix(key + rows[:, :, k])
                keys = pa.FixedSizeListArray.from_arrays(pa.array(key.ravel().view(np.int64)), BANDS).cast(pa.list_(pa.int64()))
                at, sizes = pa.array(full), pa.array([len(texts[i]) for i in full], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), sizes, keys], ["doc_id", "same", "bytes", "keys"])

    rows = docs.where("doc_id is not null").select("doc_id", _digest(), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, same binary, bytes long, keys array<long>")


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two sorted lists of shingles with weights."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    common = b[0][at] == a[0]
    low = np.minimum(a[1][common], b[1][at[common]]).sum()
    return float(low / (a[1].sum() + b[1].sum() - low))


def _weigh(shingles: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return shingles[0], shingles[1] * idf[bucket_of(shingles[0])]


def verify(pairs: DataFrame, texts: DataFrame, shared: Broadcast, similarity: float) -> DataFrame:
    """The saved table of those ``pairs(a, b)`` whose exact similarity is high enough. ``texts(id, text)`` has the texts of all.

    The texts to compare with ``a`` are dealt over slots, each of which gets the text of ``a`` once, and stream by it in sorted order.
    """
    pairs = save(pairs.withColumn("slot", F.pmod(F.xxhash64("b"), F.lit(SLOTS)).cast("int")))
    right = pairs.join(texts.withColumnRenamed("id", "b").hint("merge"), "b").select("a", "slot", F.lit(1).alias("side"), "b", "text")
    left = pairs.select("a", "slot").distinct().join(texts.withColumnRenamed("id", "a").hint("merge"), "a")
    rows = left.select("a", "slot", F.lit(0).alias("side"), F.col("a").alias("b"), "text").unionByName(right)
    rows = rows.repartition("a", "slot").sortWithinPartitions("a", "slot", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, held = shared.value, None
        for batch in batches:
            for part in slices(batch, 4):
                a, _, side, b, text = (c.to_pylist() for c in part.columns)
                linked = []
                for i, got in enumerate(shingles_of(text)):
                    if side[i] == 0:
                        held = _weigh(got, idf)
                    elif weighted_jaccard(held, _weigh(got, idf)) >= similarity - 1e-12:
                        linked.append(i)
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in linked], pa.int64()) for x in (a, b)], ["a", "b"])

    links = save(rows.mapInArrow(run, "a long, b long"))
    discard(pairs)
    return links


_CELL = ["key", "sub"]


def _cells(rows: DataFrame) -> DataFrame:
    """The cells (key, sub) of ``rows(key, sub, id, class, bytes)`` that hold several classes: home (their largest), rows and bytes, those of strays."""
    by_class = rows.groupBy(*_CELL, "class").agg(F.count("*").alias("c"), F.sum("bytes").alias("y"))
    cells = by_class.groupBy(*_CELL).agg(
        F.count("*").alias("classes"), F.sum("c").alias("n"), F.sum("y").alias("size"), F.max(F.struct("c", "y", "class")).alias("most")
    )
    strays = [(F.col("n") - F.col("most.c")).alias("strays"), (F.col("size") - F.col("most.y")).alias("stray_size")]
    return cells.where("classes > 1").select(*_CELL, F.col("most.class").alias("home"), "n", "size", *strays)


def narrowed(rows: DataFrame, cells: DataFrame, texts: DataFrame, similarity: float, shared: Broadcast) -> tuple[DataFrame, DataFrame]:
    """Rows and cells in which those above a block are split by shared rare shingles, where that makes fewer comparisons.

    Shingles are taken by rising frequency among the texts of such cells. Those at the front that weigh more than
    1 - similarity of a text are its prefix; texts that reach the similarity share a shingle of their prefixes.
    """
    large = cells.where((F.col("n") > BLOCK_ROWS) | (F.col("size") > BLOCK_BYTES))
    inside = save(rows.join(large.select(*_CELL, F.col("n").alias("_n"), F.col("strays").alias("_s")), _CELL))
    if inside.isEmpty():
        discard(inside)
        return rows, cells
    pool = texts.join(inside.select("id").distinct().hint("merge"), "id", "left_semi")
    order = texts.sparkSession.sparkContext.broadcast(frequencies(pool)[0])  # DF_BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        for batch in batches:
            for part in slices(batch, 1):
                out = []
                for got in shingles_of(part.column(1).to_pylist()):
                    x, w = _weigh(got, idf)
                    by = np.lexsort((x, order.value[bucket_of(x)]))
                    enough = np.cumsum(w[by]) > (1 - similarity) * w.sum() * (1 + 1e-9) + 1e-9
                    out.append(x[by[: int(np.argmax(enough)) + 1 if enough.any() else len(by)]].view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.list_(pa.int64()))], ["id", "subs"])

    prefixes = pool.select("id", "text").mapInArrow(run, "id long, subs array<long>")
    split = save(inside.drop("sub").join(prefixes, "id").select("key", F.explode("subs").alias("sub"), "id", "class", "bytes", "_n", "_s"))
    fine = save(_cells(split))
    work = fine.groupBy("key").agg(F.sum(F.col("n").cast("double") * F.col("strays")).alias("work"))
    known = inside.select("key", "_n", "_s").distinct().join(work, "key", "left")
    less = save(known.where(F.coalesce("work", F.lit(0.0)) < F.col("_n").cast("double") * F.col("_s")).select("key"))
    columns = [*_CELL, "id", "class", "bytes"]
    rows = rows.join(less, "key", "left_anti").select(*columns).unionByName(split.join(less, "key", "left_semi").select(*columns))
    cells = cells.join(less, "key", "left_anti").unionByName(fine.join(less, "key", "left_semi").select(*cells.columns))
    return rows, cells


def links_across(rows: DataFrame, cells: DataFrame, texts: DataFrame, similarity: float, shared: Broadcast) -> DataFrame:
    """Links ``(a, b)`` between members of different classes of a cell, saved; one for each stray and class it links with.

    A cell's strays and members are cut into blocks of bounded rows and bytes. Each pair of blocks is
    compared in one task, where each text comes once, so pairs are neither emitted nor shuffled.
    """
    cuts = lambda n, size: F.greatest(F.ceil(F.col(n) / BLOCK_ROWS), F.ceil(F.col(size) / BLOCK_BYTES), F.lit(1)).cast("int")
    rows = rows.join(cells.select(*_CELL, "home", cuts("n", "size").alias("n"), cuts("strays", "stray_size").alias("m")), _CELL)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    drawn = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    fetched = texts.select("id", "text").hint("merge")
    kept = [*_CELL, "i", "j", "id", "class"]
    left = rows.where("class <> home").withColumn("i", drawn("stray", "m")).withColumn("j", each("n")).select(*kept).join(fetched, "id")
    right = rows.withColumn("j", drawn("member", "n")).withColumn("i", each("m")).select(*kept).join(fetched, "id")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        a: list[int] = []
        b: list[int] = []
        if left.num_rows and right.num_rows:
            idf = shared.value
            mine, theirs = (shingles_of(t.column("text").to_pylist()) for t in (left, right))
            (x, xc), (y, yc) = ([t.column(c).to_numpy() for c in ("id", "class")] for t in (left, right))
            vocabulary, at = np.unique(np.concatenate([k for k, _ in theirs]), return_inverse=True)
            weight = np.concatenate([n for _, n in theirs]) * idf[bucket_of(vocabulary)][at]
            starts = np.cumsum([0, *(len(k) for k, _ in theirs)])[:-1]
            total = np.add.reduceat(weight, starts)
            own = np.zeros(len(vocabulary))
            for i, (k, n) in enumerate(mine):
                w = n * idf[bucket_of(k)]
                place = np.minimum(np.searchsorted(vocabulary, k), len(vocabulary) - 1)
                there = vocabulary[place] == k
                own[place[there]] = w[there]
                low = np.add.reduceat(np.minimum(own[at], weight), starts)
                own[place[there]] = 0
                hit = np.flatnonzero((low / (w.sum() + total - low) >= similarity - 1e-12) & (yc != xc[i]))
                hit = hit[np.unique(yc[hit], return_index=True)[1]]
                a += [int(x[i])] * len(hit)
                b += y[hit].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    keys = [*_CELL, "i", "j"]
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # both come from one table: columns need ids of their own
    return save(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest doc_id of its class), kept (doc_id = class_id).

    Classes are the connected components of pairs of at least the similarity, equal texts included.
    Texts without words (null, empty, blank) are classes of their own, as are null ids, whose
    class_id is null and which are kept. Rows that repeat a doc_id are one document with several texts and are
    marked alike. An empty table gives no rows; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(idf_table(docs))  # DF_BUCKETS numbers
    signed = save(signatures(docs, shared))
    total = signed.count()
    # Each distinct text is a node, numbered once its row is written.
    nodes = signed.groupBy("same").agg(F.min("doc_id").alias("doc_id"), F.first("bytes").alias("bytes"), F.first("keys").alias("keys"), F.count("*").alias("copies"))
    nodes = save(nodes.withColumn("id", F.monotonically_increasing_id()))
    rows = nodes.select("id", "bytes", F.explode("keys").alias("key"))
    buckets = save(rows.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("n")).where("n > 1"))
    members = save(hot_join(rows, buckets, "key", "n", total * BANDS).select("key", "id", "bytes", "leader"))

    firsts = members.groupBy("id").agg(F.min("leader").alias("first"))
    texts = docs.where("doc_id is not null").select("doc_id", _digest(), F.col("text").cast("binary").alias("text"))
    wanted = nodes.join(firsts.select("id").hint("merge"), "id", "left_semi").select("doc_id", "same", "id")
    texts = save(texts.join(wanted.hint("merge"), ["doc_id", "same"]).select("id", "text"))

    near = verify(firsts.where("first < id").select(F.col("first").alias("a"), F.col("id").alias("b")), texts, shared, similarity)
    up = near.alias("x").join(near.alias("y"), F.col("x.a") == F.col("y.b"), "left").select(F.col("x.b").alias("id"), F.coalesce("y.a", "x.a").alias("top"))
    others = members.where("leader < id").select("id", "leader").distinct().join(firsts, "id").where("first <> leader")
    others = others.join(up, "id", "left").withColumnsRenamed({"top": "id_top"})
    others = others.join(up.withColumnsRenamed({"id": "leader", "top": "leader_top"}), "leader", "left")
    others = others.where(F.coalesce("id_top", "id") != F.coalesce("leader_top", "leader"))
    more = verify(others.select(F.col("leader").alias("a"), F.col("id").alias("b")), texts, shared, similarity)
    classes = components(near.union(more))

    placed = members.join(classes.withColumnRenamed("node", "id"), "id", "left")
    placed = save(placed.select("key", F.lit(0).cast("long").alias("sub"), "id", F.coalesce("component", "id").alias("class"), "bytes"))
    cells = save(_cells(placed))
    inside = save(hot_join(placed, cells.select("key", "n"), "key", "n", total * BANDS).select(*placed.columns))
    found = links_across(*narrowed(inside, cells, texts, similarity, shared), texts, similarity, shared)

    # A doc_id with several texts ties their nodes.
    several = signed.groupBy("doc_id").agg(F.min("same").alias("low"), F.max("same").alias("high")).where("low < high").select("doc_id")
    named = signed.join(several, "doc_id").join(nodes.select("same", "id"), "same").select("doc_id", "id")
    ties = named.join(named.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").select("a", F.col("id").alias("b"))
    known = classes
    classes = components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found).union(ties))
    discard(near, more, members, buckets, texts, placed, cells, inside, found, known)

    grouped = nodes.join(classes.withColumnRenamed("node", "id"), "id", "left").where("component is not null or copies > 1")
    grouped = grouped.select("same", "doc_id", "copies", F.coalesce("component", "id").alias("component"))
    names = grouped.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    grouped = save(grouped.join(names, "component").select("same", "copies", "class_id"))
    each = hot_join(signed.select("doc_id", "same"), grouped, "same", "copies", total).groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    out = docs.select("doc_id").join(each, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    return out.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
