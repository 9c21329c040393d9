"""Harmonic packing of tokenized documents into sequences of at most CAPACITY tokens.

A document's ids, ended by id 0, are cut into whole sequences, then into pieces of CAPACITY/2,
CAPACITY/4 and CAPACITY/8 as far as they go; the tail that is left (under CAPACITY/8) stays whole.
A piece of n tokens is of class k = CAPACITY // n, and a bin of class k holds exactly k pieces: the
first three kinds fill bins completely, tails waste under a ninth of theirs. Pieces are numbered
within a class by hash bucket plus the bucket's offset, so workers fill bins independently and just
one bin of each class stays open. What the open bins hold (under k pieces for class k, at most
about 5600 pieces for any input) is packed first-fit in order of falling length.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import save, slices

CAPACITY = 1024
#: Hash buckets in which the pieces of a class are numbered.
BUCKETS = 4096
#: Words whose ids a worker remembers, and their most characters.
REMEMBERED, LONGEST = 300_000, 48

# Fixed value: the pre-tokenization pattern of byte-level BPE vocabularies of 50257 ids.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids of a byte-level BPE vocabulary in the JSON form of the ``tokenizers`` library.

    Text is cut before every single blank that stands between two non-blank characters. No token of
    the pattern crosses such a cut, so ids of the cut parts can be remembered; unknown parts of many
    documents are encoded in one call and told apart by the byte lengths of their ids.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.bpe = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.lengths = np.zeros(max([*ranks.values(), *special.values()]) + 1, dtype=np.int64)
        for t, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
            self.lengths[i] = len(t)
        #: Ids travel in two bytes where all fit.
        self.kind = encoder_kind(path)
        self.known: dict[str, bytes] = {}
        self.odd = re.compile("[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\x00]|\\n | \\n|  ")
        self.cut = re.compile(r"(?<=\S)(?= \S)")

    def parts(self, text: str) -> list[str]:
        if self.odd.search(text) or text[:1] == " " or text[-1:] == " ":
            return self.cut.split(text)
        return text.replace(" ", "\0 ").split("\0")

    def encode(self, text: str) -> bytes:
        return np.array(self.bpe.encode(text, allowed_special="all"), dtype=self.kind).tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        return [np.frombuffer(x, dtype=self.kind).astype("<u4").tobytes() for x in self.encode_narrow(texts)]

    def encode_narrow(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as numbers of the type ``kind``."""
        flat: list[str] = []
        ends = []
        for t in texts:
            flat += self.parts(t)
            ends.append(len(flat))
        ids = list(map(self.known.get, flat))
        missing = [i for i, v in enumerate(ids) if v is None]
        if missing:
            new = dict.fromkeys(flat[i] for i in missing)
            inner = [p for p in new if p[:1] == " " and p[1:2].strip() and p[-1:].strip()]
            if inner:
                got = np.array(self.bpe.encode("".join(inner), allowed_special="all"), dtype=self.kind)
                stops = (np.searchsorted(np.cumsum(self.lengths[got]), np.cumsum([len(p.encode()) for p in inner])) + 1) * got.itemsize
                raw, start = got.tobytes(), 0
                for p, stop in zip(inner, stops.tolist(), strict=True):
                    new[p] = raw[start:stop]
                    start = stop
            for p, v in new.items():
                if v is None:
                    new[p] = self.encode(p)
            for i in missing:
                ids[i] = new[flat[i]]
            if len(self.known) < REMEMBERED:
                self.known.update((p, v) for p, v in new.items() if len(p) <= LONGEST)
        out, at = [], 0
        for end in ends:
            out.append(b"".join(ids[at:end]))
            at = end
        return out


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


@functools.cache
def encoder_kind(path: str) -> np.dtype:
    """The type in which a vocabulary's ids travel, from its largest id alone."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    most = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
    return np.dtype("<u2" if most < 1 << 16 else "<u4")


def lengths_of(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces that a document of ``n`` ids is cut into."""
    out, left = [capacity] * (n // capacity), n % capacity
    for part in (capacity // 2, capacity // 4, capacity // 8):
        if left >= part:
            out.append(part)
            left -= part
    return out + [left] * (left > 0)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def cut_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: doc_id, start, length, ids_crc32 (of unsigned 32-bit ids), doc_tokens, and the ids as the encoder's ``kind``. A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        width = enc.kind.itemsize
        for batch in batches:
            for part in slices(batch, 1):
                ids = enc.encode_narrow([t or "" for t in part.column(1).to_pylist()])
                rows = []
                for doc, raw in zip(part.column(0).to_pylist(), ids, strict=True):
                    raw += b"\0" * width
                    wide = raw if width == 4 else np.frombuffer(raw, dtype=enc.kind).astype("<u4").tobytes()
                    start, n = 0, len(raw) // width
                    for size in lengths_of(n, capacity):
                        rows.append((doc, start, size, zlib.crc32(wide[4 * start : 4 * (start + size)]), n, raw[width * start : width * (start + size)]))
                        start += size
                *numbers, held = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in numbers), pa.array(held, pa.binary())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def widened(pieces: DataFrame, vocabulary: str) -> DataFrame:
    """The pieces with their ids, the last column, as little-endian unsigned 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = encoder_kind(vocabulary)
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1, 1 << 14, 16 << 20):
                ids = part.column(part.num_columns - 1).cast(pa.large_binary())
                ends = np.frombuffer(ids.buffers()[1], dtype=np.int64)[ids.offset : ids.offset + len(ids) + 1]
                flat = np.frombuffer(ids.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].view(kind).astype("<u4")
                wide = ((ends - ends[0]) * (4 // kind.itemsize)).astype(np.int32)
                out = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(wide), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], out], part.schema.names)

    return pieces.mapInArrow(run, pieces.schema)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: the columns of PIECES, sequence_id (dense from 0), offset within the sequence; ids as little-endian unsigned 32-bit numbers.

    Every id of every row lies in one piece, rows that repeat a doc_id are packed each; an empty
    text is one piece of one id; an empty table gives no rows. Other columns are ignored. Pieces are
    placed without their ids, which are joined back by a number of the piece.
    """
    spark = docs.sparkSession
    held = save(cut_documents(docs, vocabulary, capacity).withColumn("piece", F.monotonically_increasing_id()))
    pieces = held.drop("ids").withColumn("k", F.floor(F.lit(capacity) / F.col("length")).cast("int"))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(BUCKETS)))
    counts = pieces.groupBy("k", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("k", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    totals = {r["k"]: r["n"] for r in counts.groupBy("k").agg(F.sum("n").alias("n")).collect()}  # one row a class
    base, first = {}, 0
    for k in sorted(totals):
        base[k] = (first, totals[k] // k * k)
        first += totals[k] // k
    inside = Window.partitionBy("k", "bucket").orderBy("doc_id", "start", "ids_crc32", "piece")
    ranked = pieces.withColumn("r", F.row_number().over(inside).cast("long")).join(offsets, ["k", "bucket"])
    ranked = ranked.withColumn("rank", F.col("ahead") + F.col("r") - 1)
    table = F.broadcast(spark.createDataFrame([(k, b, f) for k, (b, f) in base.items()], "k int, base long, filled long"))  # one row a class
    ranked = save(ranked.join(table, "k").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "piece", "k", "rank", "base", "filled"))
    binned = ranked.where("rank < filled").select("*", (F.col("base") + F.expr("rank div k")).alias("sequence_id"))
    rest = ranked.where("rank >= filled")
    left = sorted(rest.select("length", "k", "rank").collect(), key=lambda x: (-x[0], x[1], x[2]))
    room: list[int] = []
    spots = []
    for length, k, rank in left:
        bin_ = next((i for i, free in enumerate(room) if free >= length), len(room))
        if bin_ == len(room):
            room.append(capacity)
        room[bin_] -= length
        spots.append((k, rank, first + bin_))
    table = F.broadcast(spark.createDataFrame(spots, "k int, rank long, sequence_id long"))  # under k rows for each class k
    both = binned.unionByName(rest.join(table, ["k", "rank"]).select(*binned.columns))
    ahead = Window.partitionBy("sequence_id").orderBy("k", "rank").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long")
    placed = both.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"), "piece")
    return widened(placed.join(held.select("piece", "ids"), "piece").drop("piece"), vocabulary)
