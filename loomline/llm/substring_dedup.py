"""Substring deduplication by super-k-mers.

A window is WINDOW consecutive words; its minimiser is the group of MINIMISER words in it with the
smallest hash. Consecutive windows of one minimiser travel as one string of their words to the
bucket of that minimiser, so equal windows always meet. A task sends a string once, with all the
places where it saw it, compressed by bucket. A bucket sorts its windows, compares equal-looking neighbours word for
word, and reports which windows also start in a document with a smaller doc_id.

Super-k-mers are first counted by hashes of their minimisers, over all documents. Windows of a hot minimiser are sent one by
one, to the bucket of the window itself, so that no bucket gets all strings around a common phrase. Of a string that a task
has seen at many places only the first place goes to the bucket; the bucket answers with the
first document of each of its windows, and the places, kept in rows of bounded size, are settled with that answer.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, mix, save, slices, spelled, words_of

WINDOW, MINIMISER = 13, 3
#: Bytes of text for each bucket, the fewest buckets, and bytes of strings that a task holds before it sends them.
BUCKET_BYTES, FEWEST, HELD = 8 << 20, 16, 48 << 20
#: Tasks that settle buckets: as many as there are buckets up to this number, beyond which a task settles several, one after the other.
MOST_TASKS = 20_000
#: Hash classes in which minimisers are counted, and the share of a bucket's part of all super-k-mers above which a class is hot.
CLASSES, HOT = 1 << 16, 0.25
#: Places of one string in a task above which they don't go to its bucket, and places and windows settled at a time.
MANY, CELLS = 64, 1 << 20
#: Repeated ids with different texts that are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 10_000


def runs(hashes: np.ndarray, owner: np.ndarray, window: int = WINDOW, group: int = MINIMISER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window and minimiser of each super-k-mer in words numbered through; owner tells documents apart."""
    n = len(hashes) - window + 1
    none = np.empty(0, dtype=np.int64)
    if n <= 0:
        return none, none, none.astype(np.uint64)
    m = len(hashes) - group + 1
    grams = hashes[:m].copy()
    for k in range(1, group):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[k : m + k]
    grams = mix(grams)
    width = window - group + 1
    best, at = grams[:n].copy(), np.arange(n)
    for k in range(1, width):
        other = grams[k : k + n]
        less = other < best
        best[less] = other[less]
        at[less] = np.flatnonzero(less) + k
    whole = np.flatnonzero(owner[:n] == owner[window - 1 : window - 1 + n])
    if not len(whole):
        return none, none, none.astype(np.uint64)
    new = np.concatenate([[True], (at[whole][1:] != at[whole][:-1]) | (np.diff(whole) != 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(whole)]]) - 1
    return whole[first], whole[last], best[whole[first]]


def _pack(strings: list[bytes], counts: np.ndarray, places: np.ndarray, squeeze: zstandard.ZstdCompressor, asked: np.ndarray | None = None) -> bytes:
    """Strings with their places, one string's after another's; the rows of places are doc_id, row and word.

    ``asked`` marks strings whose windows' first documents are to be told.
    """
    text = b"\n".join(strings)
    rows = places[1] if places[1].any() else places[1][:0]
    asked = np.zeros(len(strings), dtype=bool) if asked is None else asked
    head = np.array([len(strings), places.shape[1], len(text), len(rows)], dtype=np.int64)
    parts = [head, places[0].astype(np.int64), rows.astype(np.int64), places[2].astype(np.uint32), counts.astype(np.uint32), asked.astype(np.uint8)]
    return squeeze.compress(b"".join([*(x.tobytes() for x in parts), text]))


def _unpack(blob: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, m, size, k = np.frombuffer(raw, dtype=np.int64, count=4).tolist()
    at = 32
    out = []
    for kind, count in ((np.int64, m), (np.int64, k), (np.uint32, m), (np.uint32, n), (np.uint8, n)):
        out.append(np.frombuffer(raw, dtype=kind, count=count, offset=at))
        at += out[-1].nbytes
    docs, rows, word, counts, asked = out
    rows = rows if k else np.zeros(m, dtype=np.int64)
    return raw[len(raw) - size :], counts.astype(np.int64), np.stack([docs, rows, word.astype(np.int64)]), asked.astype(bool)


def _digest(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(text)


def census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Super-k-mers of texts by class of their minimiser; class -1 has the bytes of text."""
    counts, size = np.zeros(CLASSES, dtype=np.int64), 0
    for batch in batches:
        for part in slices(batch, 0):
            buf, begin, end, sizes = words_of(part.column(0).to_pylist())
            size += len(buf)
            key = runs(mix(spelled(buf, begin, end)), np.repeat(np.arange(len(sizes)), sizes))[2]
            counts += np.bincount(_class(key), minlength=CLASSES)
    full = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(full, -1)), pa.array(np.append(counts[full], size))], ["class", "n"])


def _class(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(48)).astype(np.int64)


SENT = "bucket int, blob binary, digest binary, places binary"


def send(batches: Iterator[pa.RecordBatch], buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Super-k-mers of documents (doc_id, row, text): a compressed blob for each bucket, and the places of strings seen many times."""
    squeeze = zstandard.ZstdCompressor(level=6)
    held: dict[bytes, int] = defaultdict(itertools.count().__next__)
    seen: list[np.ndarray] = []  # by place: number of the string, its key, doc_id, row, word
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        strings = list(held)
        number, key, *place = np.concatenate(seen, axis=1)
        to = (key.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        # By bucket and key, so that like strings lie side by side; a string's places by document.
        order = np.lexsort((place[0], number, key, to))
        number, to, place = number[order], to[order], np.stack(place)[:, order]
        new = np.flatnonzero(np.diff(number, prepend=-1))  # where a string's places begin
        counts = np.diff(new, append=len(number))
        asked = counts > MANY
        for i in np.flatnonzero(asked).tolist():
            digest = _digest(strings[number[new[i]]])
            for at in range(new[i], new[i] + counts[i], CELLS // 64):
                part = place[:, at : min(at + CELLS // 64, new[i] + counts[i])]
                packed = squeeze.compress(np.ascontiguousarray(part).tobytes())
                side = buckets + int.from_bytes(_digest(packed)[:8], "little") % buckets
                yield pa.RecordBatch.from_arrays([pa.array([side], pa.int32()), pa.array([None], pa.binary()), pa.array([digest], pa.binary()), pa.array([packed], pa.binary())], ["bucket", "blob", "digest", "places"])
        left = np.ones(len(number), dtype=bool)
        if asked.any():  # the first place stays, which is that of the smallest document
            left = ~np.repeat(asked, counts)
            left[new] = True
        number, to, place = number[left], to[left], place[:, left]
        counts = np.where(asked, 1, counts)
        new = np.cumsum(counts) - counts
        cuts = np.flatnonzero(np.diff(to[new], prepend=-1))  # where a bucket's strings begin
        for x, y in itertools.pairwise([*cuts.tolist(), len(new)]):
            a, z = new[x], new[y] if y < len(new) else len(number)
            blob = _pack([strings[i] for i in number[new[x:y]].tolist()], counts[x:y], place[:, a:z], squeeze, asked[x:y])
            yield pa.RecordBatch.from_arrays([pa.array([int(to[a])], pa.int32()), pa.array([blob], pa.binary()), pa.array([None], pa.binary()), pa.array([None], pa.binary())], ["bucket", "blob", "digest", "places"])

    for batch in batches:
        for part in slices(batch, 2):
            buf, begin, end, sizes = words_of(part.column(2).to_pylist())
            first, last, key = runs(mix(spelled(buf, begin, end)), np.repeat(np.arange(len(sizes)), sizes))
            if not len(first):
                continue
            heavy = hot[_class(key)]
            if heavy.any():  # windows of hot minimisers go one by one
                n = (last - first + 1)[heavy]
                w = np.repeat(first[heavy] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                own = mix(spelled(buf, begin[w], end[w + WINDOW - 1]))
                first, last, key = (np.concatenate([x[~heavy], y]) for x, y in ((first, w), (last, w), (key, own)))
            joined, known = buf.tobytes(), len(held)
            a, z = begin[first], end[last + WINDOW - 1]
            number = np.fromiter((held[joined[i:j]] for i, j in zip(a.tolist(), z.tolist(), strict=True)), dtype=np.int64, count=len(a))
            starts = np.cumsum(sizes)
            doc = np.searchsorted(starts, first, side="right")
            ids, rows = (part.column(i).to_numpy()[doc] for i in range(2))
            seen.append(np.stack([number, key.view(np.int64), ids, rows, first - (starts - sizes)[doc]]))
            _, new = np.unique(number[number >= known], return_index=True)
            size += 24 * len(a) + int((z - a)[number >= known][new].sum())
            if size > HELD:
                yield from flush()
                held, seen, size = defaultdict(itertools.count().__next__), [], 0
    if held:
        yield from flush()


def _spans(place: np.ndarray, base: np.ndarray, n_windows: np.ndarray, low: np.ndarray, window: int) -> Iterator[np.ndarray]:
    """Spans (doc_id, row, start, end) of consecutive windows whose first document, ``low`` from ``base`` on, is before the place's."""
    ends = np.cumsum(n_windows)
    cut = 0
    while cut < len(base):
        to = max(cut + 1, int(np.searchsorted(ends, ends[cut] + CELLS)))
        p, k = place[:, cut:to], n_windows[cut:to]
        q = np.repeat(np.arange(to - cut), k)
        j = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        hit = np.flatnonzero(low[base[cut:to][q] + j] < p[0][q])
        if len(hit):
            q, j = q[hit], j[hit]
            new = np.flatnonzero(np.concatenate([[True], (np.diff(q) != 0) | (np.diff(j) != 1)]))
            end = np.concatenate([new[1:], [len(q)]]) - 1
            x = q[new]
            yield np.stack([p[0][x], p[1][x], p[2][x] + j[new], p[2][x] + j[end] + window])
        cut = to


def settle(blobs: Iterator[bytes], window: int = WINDOW, answers: list[tuple[bytes, bytes]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of a bucket where repeated windows begin: doc_id, row, first word, word after the last.

    ``answers`` gets the digests of the strings that were asked for, and the first documents of their windows.
    """
    texts, counts, places, wanted = zip(*map(_unpack, blobs), strict=True)
    text, count, place, asked = b"\n".join(texts), np.concatenate(counts), np.concatenate(places, axis=1), np.concatenate(wanted)
    del texts, counts, places
    buf = np.frombuffer(text, dtype=np.uint8)
    gap = np.flatnonzero((buf == 32) | (buf == 10))
    lines = np.flatnonzero(buf[gap] == 10) + 1
    length = np.diff(lines, prepend=0, append=len(gap) + 1)
    n_windows = length - window + 1
    begin = np.cumsum(length) - length
    owner = np.repeat(np.arange(len(length)), n_windows)
    base = np.cumsum(n_windows) - n_windows
    at = begin[owner] + np.arange(len(owner)) - base[owner]
    starts = np.concatenate([[0], gap + 1])
    a, z = starts[at], np.append(gap, len(buf))[at + window - 1]
    code = spelled(buf, a, z)
    order = np.argsort(code, kind="stable")
    equal = code[order][1:] == code[order][:-1]
    i = np.flatnonzero(equal)
    left, right = order[i], order[i + 1]
    both = zip(a[left].tolist(), z[left].tolist(), a[right].tolist(), z[right].tolist(), strict=True)
    if not all(text[p:q] == text[r:s] for p, q, r, s in both):  # two different windows share a code: sort by the words themselves
        windows = [text[p:q] for p, q in zip(a.tolist(), z.tolist(), strict=True)]
        order = np.array(sorted(range(len(windows)), key=windows.__getitem__))
        equal = np.array([windows[p] == windows[q] for p, q in itertools.pairwise(order.tolist())], dtype=bool)
    group = np.empty(len(at), dtype=np.int64)
    group[order] = np.concatenate([[0], np.cumsum(~equal)])
    start = np.cumsum(count) - count
    least = np.minimum.reduceat(place[0], start)
    first = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, group, least[owner])
    low = first[group]
    if answers is not None:
        for k in np.flatnonzero(asked).tolist():
            line = text[starts[begin[k]] : z[base[k] + n_windows[k] - 1]]
            answers.append((_digest(line), low[base[k] : base[k] + n_windows[k]].tobytes()))
    most = np.maximum.reduceat(place[0], start)
    some = np.zeros(len(count), dtype=bool)
    some[owner[low < most[owner]]] = True
    some &= ~asked  # strings with a window to report at some place, which is here
    keep = np.flatnonzero(np.repeat(some, count))
    s = np.repeat(np.arange(len(count)), count)[keep]
    out = list(_spans(place[:, keep], base[s], n_windows[s], low, window))
    both = np.concatenate(out, axis=1) if out else np.empty((4, 0), dtype=np.int64)
    return both[0], both[1], both[2], both[3]


SPANS = "doc_id long, row long, start long, end long"


def _settled(table: pa.Table) -> pa.Table:
    """The spans of a bucket, with rows for its answers; the places of strings seen many times pass."""
    blobs = [b for b in table.column("blob").to_pylist() if b is not None]
    answers: list[tuple[bytes, bytes]] = []
    spans = settle(iter(blobs), answers=answers) if blobs else [np.empty(0, dtype=np.int64)] * 4
    aside = [(d, p) for d, p in zip(table.column("digest").to_pylist(), table.column("places").to_pylist(), strict=True) if d is not None]
    n, more = len(spans[0]), len(answers) + len(aside)
    columns = {c: pa.concat_arrays([pa.array(x, pa.int64()), pa.nulls(more, pa.int64())]) for c, x in zip(("doc_id", "row", "start", "end"), spans, strict=True)}
    binary = lambda ahead, held, after: pa.concat_arrays([pa.nulls(ahead, pa.binary()), pa.array(held, pa.binary()), pa.nulls(after, pa.binary())])
    columns["digest"] = binary(n, [d for d, _ in answers + aside], 0)
    columns["answer"] = binary(n, [x for _, x in answers], len(aside))
    columns["places"] = binary(n + len(answers), [p for _, p in aside], 0)
    return pa.table(columns)


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of places (places, answer)."""
    for batch in batches:
        for packed, answer in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            place = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.int64).reshape(3, -1)
            low = np.frombuffer(answer, dtype=np.int64)
            none, n = np.zeros(place.shape[1], dtype=np.int64), np.full(place.shape[1], len(low))
            for x in _spans(place, none, n, low, WINDOW):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in x], ["doc_id", "row", "start", "end"])


def repeated_spans(rows: DataFrame) -> DataFrame:
    """Spans (doc_id, row, start, end) of words under windows that also start in a smaller doc_id; ``rows`` are (doc_id, row, text)."""
    table = rows.select("text").mapInArrow(census, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).toArrow()  # CLASSES rows
    kind, n = table.column("class").to_numpy(), table.column("n").to_numpy()
    counts = np.zeros(CLASSES, dtype=np.int64)
    counts[kind[kind >= 0]] = n[kind >= 0]
    buckets = int(max(FEWEST, n[kind == -1].sum() // BUCKET_BYTES))
    hot = counts > HOT * max(counts.sum() / buckets, 1.0)
    sent = rows.where("doc_id is not null").mapInArrow(lambda b: send(b, buckets, hot), SENT)
    sent = sent.repartitionById(min(buckets, MOST_TASKS), F.col("bucket"))  # one bucket a task, not as many as hashes bring together
    found = save(sent.groupBy("bucket").applyInArrow(_settled, f"{SPANS}, digest binary, answer binary, places binary"))
    asides = found.where("places is not null").select("digest", "places")
    answers = found.where("answer is not null").groupBy("digest").agg(F.first("answer").alias("answer"))  # equal for one digest
    per_string = save(asides.groupBy("digest").agg(F.count("*").alias("n")).join(answers, "digest"))
    later = hot_join(asides, per_string, "digest", "n", asides.count()).select("places", "answer").mapInArrow(_answered, SPANS)
    return found.where("doc_id is not null").select("doc_id", "row", "start", "end").unionByName(later)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, kept_text.

    A word is removed if a window over it also starts in a document with a smaller doc_id, judged on
    the input. A null text has no words. A row with a null doc_id keeps all its words and takes none
    from others; rows that repeat a doc_id take none from each other. An empty table gives no
    rows; other columns are ignored.
    """
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    several = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("h")).groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("z"))
    several = save(several.where("a < z").select("doc_id", F.lit(True).alias("several")))
    n_several = several.count()
    if n_several:  # a hash tells the texts of one id apart; elsewhere it would only take room
        marked = docs.join(F.broadcast(several) if n_several <= MOST_BROADCAST else several, "doc_id", "left")
        rows = marked.select("doc_id", F.when(F.col("several"), F.xxhash64("text")).otherwise(0).alias("row"), "text")
    else:
        rows = docs.select("doc_id", F.lit(0).cast("long").alias("row"), "text")
    spans = repeated_spans(rows).groupBy("doc_id", "row").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.schema.get_field_index("text")):
                n, gone, digest, kept = [], [], [], []
                for text, starts, ends in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("text", "starts", "ends")), strict=True):
                    words = text.split() if text else []
                    n.append(len(words))
                    if starts:
                        depth = np.zeros(len(words) + 1, dtype=np.int64)
                        np.add.at(depth, starts, 1)
                        np.add.at(depth, ends, -1)
                        words = [w for w, d in zip(words, np.cumsum(depth[:-1]).tolist(), strict=True) if not d]
                    gone.append(n[-1] - len(words))
                    kept.append(b" ".join(words))
                    digest.append(hashlib.sha256(kept[-1]).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
                )

    return rows.join(spans, ["doc_id", "row"], "left").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
