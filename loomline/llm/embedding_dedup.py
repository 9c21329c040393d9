"""Near-duplicate vectors by product quantisation over coarse inverted lists, exactly reranked.

Unit vectors go to the inverted list of their nearest coarse centroid; their residuals are coded by
SUBSPACES codebooks, and the coding error of each is kept. A query probes every list that can hold a
vector within the distance of the least cosine: with c its own centroid and d another, vectors of d's
list lie beyond the plane halfway between c and d, at least (q.c - q.d) / |c - d| away. Table lookups
give the distance from the query to a coded vector; minus the coding error it is a lower bound of the
true distance, so the exact rerank sees every pair that can qualify. Recall thus doesn't depend
on the training sample, which only decides how much is pruned. Of two lists only the vectors of the lower one probe
the other, and what they find counts for both sides.

Equal vectors of a label are one entry with a multiplicity; those of a repeated vec_id are entries of their own. Lists are cut into bounded blocks of
entries and of queries, and a block reports counts and spanning links, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, hot_join, save

COSINE = 0.98
#: Vectors that the codebooks are fitted on: those with the smallest hashes.
SAMPLE = 8192
SUBSPACES, CODES, MOST_LISTS = 8, 64, 4096
#: Lengths of vectors, the most frequent ones, that get an index; all pairs of a label's vectors of another length are compared.
INDEXED = 4
#: Repeated ids that are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 10_000
#: Entries and queries of a block.
ENTRIES, QUERIES = 2048, 8192
#: Pairs of a query and an entry that are looked up at once: a block's queries are cut into slices of PAIRS / entries.
PAIRS = 1_000_000


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(7)
    centers = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = (x @ centers.T - 0.5 * (centers**2).sum(axis=1)).argmax(axis=1)
        for j in range(k):
            if (own := near == j).any():
                centers[j] = x[own].mean(axis=0)
    return centers


class Index:
    """Coarse centroids and residual codebooks for vectors of ``dim`` numbers."""

    def __init__(self, sample: np.ndarray, n: int) -> None:
        self.dim = sample.shape[1]
        lists = int(np.clip(round((n / 64) ** 0.5), 1, min(MOST_LISTS, len(sample))))
        self.lists = _kmeans(sample, lists)
        self.cuts = np.array_split(np.arange(self.dim), min(SUBSPACES, self.dim))
        rest = sample - self.lists[self.nearest(sample)]
        self.books = [_kmeans(rest[:, c], min(CODES, len(sample))) for c in self.cuts]

    def _closeness(self, x: np.ndarray) -> np.ndarray:
        return x @ self.lists.T - 0.5 * (self.lists**2).sum(axis=1)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return self._closeness(x).argmax(axis=1)

    def probes(self, x: np.ndarray, reach: float) -> list[np.ndarray]:
        close = self._closeness(x)
        own = close.argmax(axis=1)
        apart = np.sqrt(np.maximum(((self.lists[:, None] - self.lists[None]) ** 2).sum(axis=2), 1e-300)) if len(self.lists) <= 64 else None
        out = []
        for i, c in enumerate(own):
            gap = apart[c] if apart is not None else np.sqrt(np.maximum(((self.lists - self.lists[c]) ** 2).sum(axis=1), 1e-300))
            out.append(np.flatnonzero(close[i, c] - close[i] <= (reach + 1e-9) * gap + 1e-9))
        return out

    def encode(self, x: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the distance of each vector from what its code stands for."""
        rest = x - self.lists[near]
        codes = np.stack([(rest[:, c] @ b.T - 0.5 * (b**2).sum(axis=1)).argmax(axis=1) for c, b in zip(self.cuts, self.books, strict=True)], axis=1)
        off = rest - np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], axis=1)
        return codes.astype(np.uint8), np.sqrt((off**2).sum(axis=1))

    def distances(self, q: np.ndarray, near: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances from queries to coded vectors of one list, by one table of sub-distances a query."""
        rest = q - self.lists[near]
        out = np.zeros((len(q), len(codes)))
        for j, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            table = ((rest[:, None, c] - b[None]) ** 2).sum(axis=2)
            out += table[:, codes[:, j]]
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def _entries(usable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The saved rows (vec_id, entry) and the saved entries: entry (a digest), label, v, dim, tag, vec_id (the smallest), copies, id (a number).

    ``tag`` is the vec_id if it is repeated: such rows are in no entry with those of other ids.
    """
    several = save(usable.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id", F.col("vec_id").alias("tag")))
    n = several.count()
    if n:
        usable = usable.join(F.broadcast(several) if n <= MOST_BROADCAST else several, "vec_id", "left")
    else:
        usable = usable.withColumn("tag", F.lit(None).cast("long"))
    plain = F.transform("v", lambda x: x + 0.0)  # one zero
    digest = F.substring(F.unhex(F.sha2(F.concat_ws("|", F.col("label").cast("string"), F.coalesce(F.col("tag").cast("string"), F.lit("")), plain.cast("string")), 256)), 1, 16)
    usable = usable.select("vec_id", "label", "v", "tag", digest.alias("entry"))
    entries = usable.groupBy("entry").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.first("tag").alias("tag"), F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    entries = save(entries.withColumn("dim", F.size("v")).withColumn("id", F.monotonically_increasing_id()))
    return usable.select("vec_id", "entry"), entries


def link_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors of one label link at a double-precision cosine of at least ``cosine``. A row with a null id or
    label, or whose vector is null, empty, zero or holds a null or non-finite number links with
    nothing and is its own component (null for a null id); so do vectors of different
    lengths. Rows that repeat a vec_id are vectors of their own that share a component; their
    links with rows of other ids are added up, and those between them don't count. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    usable, entries = _entries(rows.where("vec_id is not null and label is not null and v is not null").where(fine))
    total = entries.agg(F.sum("copies")).first()[0] or 0
    base = vectors.select("vec_id")
    if not total:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    indexes = {}
    for dim, n in entries.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(INDEXED).collect():  # INDEXED rows
        sample = entries.where(F.col("dim") == dim).orderBy(F.xxhash64("v", "label"), "id").limit(SAMPLE).select("v").toArrow()  # SAMPLE rows
        indexes[dim] = Index(_unit(np.array(sample.column(0).to_pylist())), n)
    shared = spark.sparkContext.broadcast(indexes)  # at most INDEXED times MOST_LISTS centroids and the codebooks
    reach = float(np.sqrt(2 - 2 * cosine)) + 1e-7
    width = np.float32 if dict(vectors.dtypes)["embedding"] == "array<float>" else np.float64  # without loss
    kind = "label long, dim int, list int, id long, copies long, tag long, cross boolean, error double, codes binary, v binary"

    def place(batches: Iterator[pa.RecordBatch], probing: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                label, v, id_, copies, dims, tag = (part.column(part.schema.get_field_index(c)) for c in ("label", "v", "id", "copies", "dim", "tag"))
                out = []  # (row, list, whether it isn't the row's own, error, codes)
                arrays = [np.array(x) for x in v.to_pylist()]
                for dim, index in shared.value.items():
                    own = [i for i, x in enumerate(arrays) if len(x) == dim]
                    if own:
                        x = _unit(np.stack([arrays[i] for i in own]))
                        near = index.nearest(x)
                        if probing:
                            out += [(i, int(p), bool(p != n), 0.0, b"") for i, n, ps in zip(own, near, index.probes(x, reach), strict=True) for p in ps if p >= n]
                        else:
                            codes, error = index.encode(x, near)
                            out += [(i, int(p), False, float(e), c.tobytes()) for i, p, e, c in zip(own, near, error, codes, strict=True)]
                # Vectors of another length are one list, compared exactly.
                out += [(i, -1, False, 0.0, b"") for i, x in enumerate(arrays) if len(x) not in shared.value]
                take = pa.array([o[0] for o in out], pa.int64())
                raw = pa.array([x.astype(width).tobytes() for x in arrays], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [label.take(take), dims.take(take), pa.array([o[1] for o in out], pa.int32()), id_.take(take), copies.take(take), tag.take(take), pa.array([o[2] for o in out], pa.bool_()), pa.array([o[3] for o in out], pa.float64()), pa.array([o[4] for o in out], pa.binary()), raw.take(take)],
                    ["label", "dim", "list", "id", "copies", "tag", "cross", "error", "codes", "v"],
                )

    coded = save(entries.mapInArrow(lambda b: place(b, False), kind))
    asked = entries.mapInArrow(lambda b: place(b, True), kind)
    cell = ["label", "dim", "list"]
    blocks = coded.groupBy(*cell).agg(F.count("*").alias("n")).select(*cell, F.ceil(F.col("n") / ENTRIES).cast("int").alias("n_blocks"))
    # Hashes spread a cell's rows over its blocks; what queries it gets is cut by their own count.
    asked = save(asked.join(blocks, cell))
    turns = asked.groupBy(*cell).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("n_turns"))
    spread = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    right = coded.join(blocks, cell).join(turns, cell).withColumn("block", spread("entry", "n_blocks"))
    right = right.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("n_turns") - 1))).drop("n_blocks", "n_turns")
    left = asked.join(turns, cell).withColumn("turn", spread("query", "n_turns"))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).drop("n_blocks", "n_turns")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        tops: list[np.ndarray] = []
        if left.num_rows and right.num_rows:
            near, dim = left.column("list")[0].as_py(), left.column("dim")[0].as_py()
            get = lambda t: _unit(np.frombuffer(b"".join(t.column("v").to_pylist()), dtype=width).astype(np.float64).reshape(-1, dim))
            tags = lambda t: t.column("tag").combine_chunks().fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            x, xid, copies, xtag = get(right), right.column("id").to_numpy(), right.column("copies").to_numpy(), tags(right)
            error = right.column("error").to_numpy()
            codes = np.frombuffer(b"".join(right.column("codes").to_pylist()), dtype=np.uint8).reshape(len(x), -1)
            label, gained = xid.copy(), np.zeros(len(xid), dtype=np.int64)
            step = max(1, PAIRS // len(x))
            for at in range(0, left.num_rows, step):
                part = left.slice(at, step)
                q, qid, qtag = get(part), part.column("id").to_numpy(), tags(part)
                cross, held = part.column("cross").to_numpy(), part.column("copies").to_numpy()
                if near >= 0:
                    maybe = np.sqrt(np.maximum(shared.value[dim].distances(q, near, codes), 0)) - error[None] <= reach
                else:
                    maybe = np.ones((len(q), len(x)), dtype=bool)
                i, j = np.nonzero(maybe)
                ok = np.empty(len(i), dtype=bool)
                for cut in range(0, len(i), 1 << 18):
                    a, b = i[cut : cut + (1 << 18)], j[cut : cut + (1 << 18)]
                    ok[cut : cut + (1 << 18)] = (q[a] * x[b]).sum(axis=1) >= cosine
                i, j = i[ok], j[ok]
                other = (qid[i] != xid[j]) & ((qtag[i] != xtag[j]) | (qtag[i] == np.iinfo(np.int64).min))
                i, j = i[other], j[other]
                if not len(i):
                    continue
                mine, before = qid.copy(), label.copy()
                while True:
                    was = mine.copy(), label.copy()
                    np.minimum.at(mine, i, label[j])
                    np.minimum.at(label, j, mine[i])
                    if (was[0] == mine).all() and (was[1] == label).all():
                        break
                hit = np.unique(i)
                ids.append(qid[hit])
                counts.append(np.bincount(i, weights=copies[j], minlength=len(q))[hit].astype(np.int64))
                tops.append(mine[hit])
                gained += np.bincount(j, weights=held[i] * cross[i], minlength=len(x)).astype(np.int64)
                # Each label an entry has had is reported, as queries of earlier slices are tied to it by that one only.
                moved = np.flatnonzero(label != before)
                ids.append(xid[moved]), counts.append(np.zeros(len(moved), dtype=np.int64)), tops.append(label[moved])
            hit = np.flatnonzero(gained)
            ids.append(xid[hit]), counts.append(gained[hit]), tops.append(label[hit])
        cat = lambda a: pa.array(np.concatenate(a) if a else [], pa.int64())
        return pa.table({"id": cat(ids), "n": cat(counts), "top": cat(tops)})

    keys = [*cell, "block", "turn"]
    found = save(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "id long, n long, top long"))
    discard(coded, asked)
    linked = found.groupBy("id").agg(F.sum("n").alias("n"))
    tagged = entries.where("tag is not null").select("tag", "id")
    ties = tagged.join(tagged.groupBy("tag").agg(F.min("id").alias("a")), "tag").select("a", F.col("id").alias("b"))
    classes = components(found.select(F.col("id").alias("a"), F.col("top").alias("b")).union(ties))
    done = entries.select("entry", "tag", "id", "vec_id", "copies").join(linked, "id", "left").join(classes.withColumnRenamed("node", "id"), "id", "left")
    same = F.when(F.col("tag").isNull(), F.col("copies") - 1).otherwise(0)
    done = done.select("entry", "copies", "vec_id", (F.coalesce("n", F.lit(0)) + same).alias("n"), F.coalesce("component", "id").alias("component"))
    names = done.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    done = save(done.select("entry", "copies", "n", "component").join(names, "component").drop("component"))
    each = hot_join(usable, done, "entry", "copies", total).groupBy("vec_id").agg(F.sum("n").alias("n"), F.min("component_id").alias("component_id"))
    out = base.join(each, "vec_id", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
