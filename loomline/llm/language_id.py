"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ORDER bytes, counted on a bounded sample of its
labelled documents. A byte costs -log2 of its frequency in the longest known context, where a
context with t bytes of q kinds gives (t+q) in the denominator and escapes with q/(t+q) to the next
shorter one, down to all 256 bytes alike. The statistics are frozen, so a text's code length is a
sum over its bytes and can be cut anywhere; the language with the shortest code wins.

The sum is kept as a dense table for pairs of bytes and corrections for the triples and quadruples of bytes that a
language knows: a model takes room for what the samples hold, not for all contexts in all languages. It grows with the
number of languages in ``lang`` (at most 0.5 MB for each one's pairs).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import save, slices

ORDER = 3
#: Documents of each language that the trees are counted on, whole, those with the smallest hashes of their ids; ones of more bytes
#: than LONGEST are taken only where a language has too few others.
SAMPLE, LONGEST = 300, 40_000
UNKNOWN = "und"
#: Documents and bytes scored at a time.
_PART, _BYTES = 512, 1 << 16
#: Tables of more cells are searched by halving instead of being laid out; it makes no difference to the result.
MOST_CELLS = 1 << 22
#: Rows, one for each language, that are broadcast.
MOST_BROADCAST = 10_000


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def _grams(text: bytes) -> np.ndarray:
    """The quadruples of bytes in a text between two runs of line ends, as numbers."""
    lead = b"\n" * ORDER
    x = np.frombuffer(lead + text + lead, dtype=np.uint8).astype(np.uint32)
    return (x[:-3] << 24) | (x[1:-2] << 16) | (x[2:-1] << 8) | x[3:]


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds, at = np.unique(keys, return_inverse=True)
    return kinds, np.bincount(at, weights=n)


class _Rows:
    """Rows of a value for each language, by key. Few rows are kept whole, many as (language, value) pairs."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]], domain: int) -> None:
        every = np.concatenate([np.empty(0, dtype=np.int64), *(k for k, _ in parts)])
        lang = np.repeat(np.arange(len(parts), dtype=np.int32), [len(k) for k, _ in parts])
        value = np.concatenate([np.empty(0), *(v for _, v in parts)]).astype(np.float32)
        order = np.argsort(every, kind="stable")
        self.keys, first = np.unique(every[order], return_index=True)
        self.domain, self.langs = domain, len(parts)
        self.ends = np.append(first, len(every)).astype(np.int64)
        self.lang, self.value = lang[order], value[order]
        self.__setstate__(self.__getstate__())

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("table", "whole")}

    def __setstate__(self, state: dict) -> None:
        """What speeds up lookups is made where it is used, so it doesn't travel."""
        self.__dict__.update(state)
        self.table = self.whole = None
        if self.domain <= MOST_CELLS:
            self.table = np.full(self.domain, len(self.keys), dtype=np.int32)
            self.table[self.keys] = np.arange(len(self.keys))
        if (len(self.keys) + 1) * self.langs <= MOST_CELLS:
            self.whole = np.zeros((len(self.keys) + 1, self.langs), dtype=np.float32)
            self.whole[np.repeat(np.arange(len(self.keys)), np.diff(self.ends)), self.lang] = self.value

    def find(self, key: np.ndarray) -> np.ndarray:
        """The row of each key, and the number of rows for unknown ones."""
        if self.table is not None:
            return self.table[key]
        at = np.searchsorted(self.keys, key)
        at[self.keys[np.minimum(at, len(self.keys) - 1)] != key] = len(self.keys)
        return at

    def sums(self, row: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """The sum of the rows by owner, who ascend from 0 to n - 1 and each have some."""
        if self.whole is not None:
            return np.add.reduceat(self.whole[row], np.flatnonzero(np.diff(owner, prepend=-1)), axis=0, dtype=np.float64)
        hit = np.flatnonzero(row < len(self.keys))
        size = self.ends[row[hit] + 1] - self.ends[row[hit]]
        where = np.repeat(self.ends[row[hit]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        cell = np.repeat(owner[hit] * self.langs, size) + self.lang[where]
        return np.bincount(cell, weights=self.value[where], minlength=n * self.langs).reshape(n, self.langs)


class Model:
    """Frozen code lengths. ``pair`` has the cost of a byte after one byte, and ``escape`` that of leaving a context of
    two, by language; ``triple``, ``leave`` (of a context of three) and ``quad`` correct the sum where a language knows more."""

    def __init__(self, samples: dict[str, list[bytes]]) -> None:
        counts, seen = {}, np.zeros(256, dtype=bool)
        for lang, texts in samples.items():
            for t in texts:
                seen[np.frombuffer(t, dtype=np.uint8)] = True
            counts[lang] = np.unique(np.concatenate([_grams(t) for t in texts]), return_counts=True)
        self._build(counts, seen)

    @classmethod
    def counted(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]], seen: np.ndarray) -> Model:
        """From the quadruples of each language with their numbers, and which bytes the texts hold."""
        model = cls.__new__(cls)
        model._build(counts, seen)
        return model

    def _build(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], seen: np.ndarray) -> None:
        self.langs = sorted(counts)
        # Bytes never seen share one symbol, which is also that of the line ends around a text if it holds none.
        a = self.a = int(seen.sum()) + 1
        self.symbol = np.full(256, a - 1, dtype=np.int64)
        self.symbol[seen] = np.arange(a - 1)
        pairs, escapes, triples, leaves, quads, known = [], [], [], [], [], []
        for lang in self.langs:
            g, n4 = counts[lang][0].astype(np.int64), counts[lang][1].astype(np.float64)
            s = [self.symbol[(g >> k) & 0xFF] for k in (24, 16, 8, 0)]
            g3, n3 = _summed((s[1] * a + s[2]) * a + s[3], n4)
            one = np.bincount(s[3], weights=n4, minlength=a)
            two = np.bincount(s[2] * a + s[3], weights=n4, minlength=a * a).reshape(a, a)
            pair = -np.log2(_blend(two, _blend(one[None], np.full((1, a), 1 / 256)))).ravel()
            before = (s[0] * a + s[1]) * a + s[2]
            (c3, t3, q3), (c2, t2, q2) = self._contexts(before, n4), self._contexts(g3 // a, n3)
            escape = np.zeros(a * a)
            escape[c2] = -np.log2(q2 / (t2 + q2))
            cost3 = -np.log2(n3 / (t2 + q2)[np.searchsorted(c2, g3 // a)])
            leave = -np.log2(q3 / (t3 + q3))
            at3 = np.searchsorted(c3, before)
            last = cost3[np.searchsorted(g3, (s[1] * a + s[2]) * a + s[3])]
            pairs.append(pair), escapes.append(escape)
            triples.append((g3, cost3 - pair[g3 % (a * a)] - escape[g3 // a]))
            leaves.append((c3, leave))
            known.append(c3)
            quads.append((before, s[3], -np.log2(n4 / (t3 + q3)[at3]) - last - leave[at3]))
        self.pair, self.escape = (np.array(x, dtype=np.float32).reshape(len(x), a * a).T.copy() for x in (pairs, escapes))
        self.triple, self.leave = _Rows(triples, a**3), _Rows(leaves, a**3)
        # A quadruple is named by the row of its context and its last byte.
        contexts = self.leave.keys
        self.quad = _Rows([(np.searchsorted(contexts, c) * a + x, v) for c, x, v in quads], (len(contexts) + 1) * a)

    @staticmethod
    def _contexts(context: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct contexts, how many bytes followed each, and of how many kinds."""
        kinds, at, q = np.unique(context, return_inverse=True, return_counts=True)
        return kinds, np.bincount(at, weights=n), q.astype(np.float64)

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths, a row per text and a column per language."""
        out = np.zeros((len(texts), max(1, len(self.langs))))
        if not self.langs:
            return out
        lead, a, at = b"\n" * ORDER, self.a, 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) <= _BYTES):
                size += len(texts[stop])
                stop += 1
            raw = np.frombuffer(lead + lead.join(texts[at:stop]), dtype=np.uint8)
            owner = np.repeat(np.arange(at, stop), [len(t) for t in texts[at:stop]])
            place = np.arange(len(owner)) + ORDER * (owner - at + 1)
            for cut in range(0, len(owner), _BYTES):
                i, who = place[cut : cut + _BYTES], owner[cut : cut + _BYTES]
                names, who = np.unique(who, return_inverse=True)
                x = self.symbol[raw[int(i[0]) - ORDER : int(i[-1]) + 1]]
                i = i - i[0] + ORDER
                two = x[:-1] * a + x[1:]  # place p holds the pair from p on
                three = two[:-1] * a + x[2:]
                context = self.leave.find(three[i - 3])
                parts = (self.triple, self.triple.find(three[i - 2])), (self.leave, context), (self.quad, self.quad.find(context * np.int64(a) + x[i]))
                base = self.pair[two[i - 1]] + self.escape[two[i - 2]]
                sums = np.add.reduceat(base, np.flatnonzero(np.diff(who, prepend=-1)), axis=0, dtype=np.float64)
                for rows, row in parts:
                    sums += rows.sums(row, who, len(names))
                out[names] += sums
            at = stop
        return out


def _blend(counts: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Frequencies of a context's known bytes, and the escape's share of ``below`` for the others."""
    total, kinds = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
    known = counts / np.maximum(total + kinds, 1)
    escape = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0)
    return np.where(counts > 0, known, escape * below)


def sample_of(docs: DataFrame, sample: int, longest: int) -> DataFrame:
    """At most ``sample`` rows (lang, text) of each language with their whole texts, those of up to ``longest`` bytes before others.

    The languages' documents are counted first; a share of them by hash, about twice the sample, is ranked.
    """
    long, drawn = (F.octet_length("text") > longest).alias("long"), F.xxhash64("doc_id").alias("h")
    rows = docs.where(remainder(F.col("doc_id")) != 2).where("lang is not null and octet_length(text) > 0")
    counts = save(rows.groupBy("lang", long).agg(F.count("*").alias("n")))
    few = counts.count() <= MOST_BROADCAST  # else texts are shuffled by language
    near = rows.select("lang", long, drawn, F.col("text").cast("binary").alias("text"))
    near = near.join(F.broadcast(counts) if few else counts, ["lang", "long"])
    near = near.where(F.pmod(F.shiftrightunsigned("h", 16), F.lit(1 << 31)) * F.col("n") < F.lit(float(1 << 31)) * 2 * sample)
    order = Window.partitionBy("lang").orderBy("long", "h", "text")
    return near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample).select("lang", "text")


def fit(docs: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> Model:
    """Trees of each language in ``lang``, from at most ``sample`` documents, longer ones than ``longest`` bytes only where others are too few.

    Only documents with a lang and a text whose crc32(doc_id) mod 4 is not 2 are learned from. The quadruples of bytes
    are counted in the tasks; what comes to the driver are their distinct ones by language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                grams, n = np.unique(_grams(text), return_counts=True)
                held = np.unique(np.frombuffer(text, dtype=np.uint8)).astype(np.int64) - 256  # below 0: bytes of texts
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * (len(grams) + len(held)), pa.string()), pa.array(np.concatenate([grams.astype(np.int64), held])), pa.array(np.concatenate([n, np.ones(len(held), dtype=np.int64)]))],
                    ["lang", "gram", "n"],
                )

    rows = sample_of(docs, sample, longest).mapInArrow(run, "lang string, gram long, n long")
    table = rows.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    gram, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
    coded = table.column("lang").combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    names, lang = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    counts, seen = {}, np.zeros(256, dtype=bool)
    seen[gram[gram < 0] + 256] = True
    for i, name in enumerate(names):
        own = np.flatnonzero((lang == i) & (gram >= 0))
        own = own[np.argsort(gram[own])]
        counts[name] = gram[own], n[own]
    return Model.counted(counts, seen)


_ASCII = re.compile(rb"[A-Za-z]")


def _lettered(text: bytes) -> bool:
    return bool(_ASCII.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` as doc_id, held_out, lang_pred, score.

    The score is the predicted language's share of the probability that the languages' models give
    the text. A null text, one without a letter, and any text where no language was learned are
    ``und`` with score 0. A null doc_id counts as not held out. Repeated rows are judged alike.
    """
    model = model or fit(docs)
    held = F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False))
    rows = docs.select("doc_id", held.alias("held_out"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(scorer(docs, model, ["doc_id", "held_out"]), "doc_id long, held_out boolean, lang_pred string, score double")


def scorer(docs: DataFrame, model: Model, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")):
    """A function for mapInArrow that puts the predicted language and its score after the columns ``keep``, from ``text`` in bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by what the sample's texts hold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, batch.schema.get_field_index("text"), _PART):
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                sure = [bool(t) and bool(model.langs) and _lettered(t) for t in texts]
                bits = model.bits([t if ok else b"" for t, ok in zip(texts, sure, strict=True)])
                best = bits.argmin(axis=1)
                score = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
                langs = [model.langs[b] if ok else UNKNOWN for b, ok in zip(best, sure, strict=True)]
                columns = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(np.where(sure, score, 0.0))], [*keep, *names])

    return run
