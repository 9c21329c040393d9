"""Chat formatting by columnar byte assembly, and its inverse.

A turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``. For a batch of turns the lengths of all
segments give offsets and scatter indices, and headers and contents are copied into one
preallocated buffer that becomes the Arrow column of formatted conversations without another copy.

Control strings inside a role or a text get a backslash after their first character; one that has
n backslashes there gets n+1, so taking one away restores the text. In roles, line ends are masked
as well. Only assistants' texts lie under the loss mask, which is kept as code point spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

START, MIDDLE, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"
# Strings that templates use as control strings; all start with < or [.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_REST = "|".join(re.escape(c[1:]) for c in sorted(CONTROL, key=len, reverse=True))
_HIDE = re.compile(rf"([<\[])(\\*)({_REST})".encode())
_SHOW = re.compile(rf"([<\[])\\(\\*)({_REST})".encode())
LEARNED = "assistant"


def escape(text: bytes) -> bytes:
    return _HIDE.sub(rb"\1\\\2\3", text) if b"<" in text or b"[" in text else text


def unescape(text: bytes) -> bytes:
    return _SHOW.sub(rb"\1\2\3", text) if b"\\" in text else text


def escape_role(role: bytes) -> bytes:
    return escape(role).replace(b"%", b"%25").replace(b"\n", b"%0A")


def unescape_role(role: bytes) -> bytes:
    return unescape(role.replace(b"%0A", b"\n").replace(b"%25", b"%"))


#: Bytes that are scattered or counted at a time, and bytes of texts that are assembled into one batch, but for longer conversations.
_CHUNK, BATCH = 1 << 20, 8 << 20


def _points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points of UTF-8 before each of some ascending byte offsets."""
    out, before = np.empty(len(at), dtype=np.int64), 0
    for low in range(0, len(data) + 1, _CHUNK):
        part = (data[low : low + _CHUNK] & 0xC0) != 0x80
        a, z = np.searchsorted(at, [low, low + _CHUNK])
        if z > a:
            out[a:z] = before + np.concatenate([[0], np.cumsum(part)])[at[a:z] - low]
        before += int(part.sum())
    return out


def assemble(conv: np.ndarray, roles: list[bytes], texts: list[bytes]) -> tuple[pa.Array, list[list[int]], list[list[int]]]:
    """Formatted conversations of turns numbered by ``conv`` (0, 0, 1, ...), and the starts and ends of their loss spans."""
    fixed = START + MIDDLE + END
    parts = b"".join([fixed, *(x for pair in zip(roles, texts, strict=True) for x in pair)])
    source = np.frombuffer(parts, dtype=np.uint8)
    n = len(texts)
    held = np.array([len(x) for pair in zip(roles, texts, strict=True) for x in pair], dtype=np.int64).reshape(n, 2)
    at = len(fixed) + np.concatenate([[0], np.cumsum(held.ravel())[:-1]]).reshape(n, 2)
    lengths = np.empty((n, 5), dtype=np.int64)
    begin = np.empty((n, 5), dtype=np.int64)
    for k, piece, offset in ((0, START, 0), (2, MIDDLE, len(START)), (4, END, len(START + MIDDLE))):
        lengths[:, k], begin[:, k] = len(piece), offset
    lengths[:, 1], lengths[:, 3], begin[:, 1], begin[:, 3] = held[:, 0], held[:, 1], at[:, 0], at[:, 1]
    ends = np.cumsum(lengths.ravel())
    starts = ends - lengths.ravel()
    out = np.empty(int(ends[-1]), dtype=np.uint8)
    # Byte i of the output comes from i plus its segment's shift; indices are made for a part of the output at a time.
    shift = begin.ravel() - starts
    for low in range(0, len(out), _CHUNK):
        high = min(len(out), low + _CHUNK)
        a, z = np.searchsorted(ends, low, side="right"), np.searchsorted(starts, high)
        size = np.minimum(ends[a:z], high) - np.maximum(starts[a:z], low)
        out[low:high] = source[np.arange(low, high) + np.repeat(shift[a:z], size)]
    turns = ends.reshape(n, 5)
    last = np.concatenate([np.flatnonzero(np.diff(conv)), [n - 1]])
    offsets = np.concatenate([[0], turns[last, 4]])
    formatted = pa.Array.from_buffers(pa.large_string(), len(last), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)])
    learned = np.flatnonzero(np.array([r == LEARNED.encode() for r in roles]))
    head = offsets[conv[learned]]
    # Where a turn's text starts and ends, counted from its conversation; conversations ascend, and so do all offsets.
    edges = _points(out, np.stack([turns[learned, 2], turns[learned, 3]], axis=1).ravel()).reshape(-1, 2)
    zero = _points(out, head)
    spans = edges[:, 0] - zero, edges[:, 1] - zero
    cuts = np.searchsorted(conv[learned], np.arange(1, len(last)))
    return formatted, *([x.tolist() for x in np.split(s, cuts)] for s in spans)


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_starts, loss_ends (code points, end exclusive).

    Turns stand in order of turn (null first), then role and text; null roles and texts are empty
    and repeated rows are turns of their own. Rows of a null conv_id are one conversation. An empty
    table gives no rows. Conversations stream through sorted partitions and are assembled a batch at a
    time, so only the conversation at hand is held.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).cast("binary").alias("role"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def flush(ids: list, roles: list, texts: list) -> pa.RecordBatch:
        new = np.array([0] + [int(a != b) for a, b in zip(ids, ids[1:])])
        conv = np.cumsum(new)
        formatted, starts, ends = assemble(conv, [escape_role(r) for r in roles], [escape(t) for t in texts])
        names = [ids[0], *(ids[i] for i in np.flatnonzero(new))]
        kinds = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), formatted.cast(pa.string()), pa.array(starts, kinds), pa.array(ends, kinds)], ["conv_id", "formatted", "loss_starts", "loss_ends"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        roles: list = []
        texts: list = []
        size = held = 0  # bytes of the conversations that are complete, and of the one at hand
        for batch in batches:
            for part in slices(batch, 2, 2000, BATCH):
                for conv, role, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if ids and conv != ids[-1]:
                        size, held = size + held, 0
                        if size > BATCH or len(ids) >= 2000:
                            yield flush(ids, roles, texts)
                            ids, roles, texts, size = [], [], [], 0
                    ids.append(conv), roles.append(role), texts.append(text)
                    held += len(role) + len(text)
        if ids:
            yield flush(ids, roles, texts)

    return rows.mapInArrow(run, "conv_id long, formatted string, loss_starts array<long>, loss_ends array<long>")


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    out = []
    for turn in formatted.encode().split(START)[1:]:
        role, _, rest = turn.partition(MIDDLE)
        if not rest.endswith(END):
            raise ValueError("a turn has no end")
        out.append((unescape_role(role).decode(), unescape(rest[: -len(END)]).decode()))
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, taken from the formatted text and its mask alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, starts, ends in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                turns = parse(text)
                said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                learned = [unescape(text[a:b].encode()) for a, b in zip(starts, ends, strict=True)]
                joined = b"".join(learned)
                rows.append((conv, len(turns), said, len(joined.decode()), hashlib.sha256(joined).hexdigest(), len(text)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
