"""Sides of JPEG images from as few bytes as hold them: ranged reads of files, base64 and streams.

The parser asks for the bytes it needs and keeps its state meanwhile, so a source hands over a chunk at a time and segments
that the parser passes over aren't read at all where the source can seek.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Generator, Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pf
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes that are read at a time, and files of a partition.
CHUNK, FILES = 8192, 256
# Markers of frame headers, and of segments without a length.
FRAMES = {0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}
BARE = {0x01, *range(0xD0, 0xD8)}
Read = Callable[[int, int], bytes]


def _header() -> Generator[tuple[int, int], bytes, tuple[int, int] | None]:
    """Asks for bytes by place and number; returns the sides (width, height), or None where the image ends without them."""
    if (yield 0, 2) != b"\xff\xd8":
        raise ValueError("not a JPEG stream")
    at = 2
    while True:
        byte = (yield at, 1)[0]
        at += 1
        if byte != 0xFF:
            continue
        while byte == 0xFF:
            byte = (yield at, 1)[0]
            at += 1
        if byte == 0xD9:
            return None
        if byte in BARE:
            continue
        length = int.from_bytes((yield at, 2), "big")
        if length < 2:
            raise ValueError(f"invalid JPEG segment length: {length}")
        if byte in FRAMES:
            sides = yield at + 3, 4
            return int.from_bytes(sides[2:], "big"), int.from_bytes(sides[:2], "big")
        at += length


def sides(read: Read, chunk: int = CHUNK) -> tuple[tuple[int, int] | None, int]:
    """(width, height) and the bytes read for them; no sides where the source ends before them. ValueError for what isn't a JPEG."""
    parser, low, held, total = _header(), 0, b"", 0
    at, n = next(parser)
    while True:
        if not low <= at <= at + n <= low + len(held):
            kept = held[at - low :] if low <= at < low + len(held) else b""
            more = read(at + len(kept), max(chunk, n - len(kept)))
            low, held, total = at, kept + more, total + len(more)
            if len(held) < n:
                return None, total
        try:
            at, n = parser.send(held[at - low : at - low + n])
        except StopIteration as end:
            return end.value, total


def of_bytes(content: bytes) -> Read:
    return lambda at, n: content[at : at + n]


class _Letters:
    """A stream of what base64 in lines stands for; letters that don't fill a group of four wait for the next part."""

    def __init__(self, coded: str) -> None:
        self.coded, self.place, self.carry, self.left = coded, 0, "", b""

    def read(self, n: int) -> bytes:
        while len(self.left) < n and self.place < len(self.coded):
            self.carry += "".join(self.coded[self.place : self.place + CHUNK].split())
            self.place += CHUNK
            whole = len(self.carry) if self.place >= len(self.coded) else len(self.carry) // 4 * 4
            group, self.carry = self.carry[:whole], self.carry[whole:]
            self.left += base64.b64decode(group + "=" * (-len(group) % 4))
        out, self.left = self.left[:n], self.left[n:]
        return out


def of_base64(coded: str) -> Read:
    """Reads of what whole groups of four letters stand for; letters in lines are gone through in order."""
    if any(c in coded for c in " \t\r\n"):
        return of_stream(_Letters(coded))

    def read(at: int, n: int) -> bytes:
        part = coded[at // 3 * 4 : -(-(at + n) // 3) * 4]
        return base64.b64decode(part + "=" * (-len(part) % 4))[at % 3 : at % 3 + n]

    return read


def of_stream(stream: BinaryIO) -> Read:
    """Reads of a stream that can't go back; what lies between two is read and dropped."""
    place = 0

    def take(n: int) -> bytes:
        nonlocal place
        parts = []
        while n and (part := stream.read(n)):
            parts.append(part)
            place += len(part)
            n -= len(part)
        return b"".join(parts)

    def read(at: int, n: int) -> bytes:
        while place < at and take(min(at - place, CHUNK)):
            pass
        return take(n) if place == at else b""

    return read


def of_file(file: pa.NativeFile) -> Read:
    size = file.size()
    return lambda at, n: file.read_at(min(n, size - at), at) if at < size else b""


def file_sides(fs: pf.FileSystem, path: str, chunk: int = CHUNK) -> tuple[int | None, int | None, int, int, str | None]:
    """Width, height, bytes read, length and error of one file, which is decoded whole only if it is no JPEG."""
    from loomline.functions import images

    with fs.open_input_file(path) as file:
        total = 0
        try:
            try:
                found, total = sides(of_file(file), chunk)
            except ValueError:
                found = None
            if found is None:
                total = file.size()
                height, width = images.decode(file.read_at(total, 0)).shape[:2]
                found = width, height
            return *found, total, file.size(), None
        except Exception as e:  # noqa: BLE001  a broken image is data here
            return None, None, total, file.size(), f"{type(e).__name__}: {e}"


class _Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.uri, self.chunk = options["path"], int(options.get("chunk", CHUNK))

    def partitions(self) -> list[_Files]:
        fs, root = pf.FileSystem.from_uri(self.uri)
        paths = sorted(f.path for f in fs.get_file_info(pf.FileSelector(root, recursive=True)) if f.is_file and not f.base_name.startswith((".", "_")))
        return [_Files(paths[i : i + FILES]) for i in range(0, len(paths), FILES)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        fs, _ = pf.FileSystem.from_uri(self.uri)
        for path in partition.paths:
            yield path, *file_sides(fs, path, self.chunk)


class ImageHeads(DataSource):
    """``spark.read.format("imageheads").load(folder)``: path, sides, bytes read for them, length and error of every file.

    The folder is one that Arrow's file systems open (a mounted path, s3, gs, hdfs); option ``chunk`` sets the bytes read at a time.
    """

    @classmethod
    def name(cls) -> str:
        return "imageheads"

    def schema(self) -> str:
        return "path string, width int, height int, bytes_read long, length long, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
