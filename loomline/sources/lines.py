"""Lines of growing files and HTTP resources as a stream with offsets.

An offset is the number of bytes of each resource up to the end of a whole line. A trigger plans the ranges that have come since and
tasks read them, so a range that is read again after a failure holds the same lines.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.request import Request, urlopen

import pyarrow.fs as pf
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that are looked at for the last line's end, and bytes of a task's range, but for longer lines.
TAIL, RANGE = 1 << 16, 8 << 20
#: Ranges of a task at most, and resources whose ends are looked for at once.
SHARED, LOOKS = 128, 16


def _is_http(url: str) -> bool:
    return url.startswith(("http://", "https://"))


def size_of(url: str) -> int:
    """Bytes that a resource has now; 0 where there is none yet."""
    if _is_http(url):
        with urlopen(Request(url, method="HEAD"), timeout=30) as got:
            return int(got.headers["Content-Length"])
    fs, path = pf.FileSystem.from_uri(url)
    info = fs.get_file_info(path)
    return info.size if info.type == pf.FileType.File else 0


def read_range(url: str, start: int, stop: int) -> bytes:
    if stop <= start:
        return b""
    if _is_http(url):
        with urlopen(Request(url, headers={"Range": f"bytes={start}-{stop - 1}"}), timeout=30) as got:
            data = got.read()
            return data if got.status == 206 else data[start:stop]
    fs, path = pf.FileSystem.from_uri(url)
    with fs.open_input_file(path) as file:
        return file.read_at(stop - start, start)


def line_end(url: str, start: int, stop: int) -> int:
    """Where the last whole line before ``stop`` ends; ``start`` if none does."""
    size = TAIL
    while stop > start:
        low = max(start, stop - size)
        at = read_range(url, low, stop).rfind(b"\n")
        if at >= 0:
            return low + at + 1
        if low == start:
            break
        size *= 2
    return start


class _Ranges(InputPartition):
    """(url, start, stop, last) of each range that a task reads."""

    def __init__(self) -> None:
        self.ranges: list[tuple[str, int, int, int]] = []


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.urls = json.loads(options["urls"]) if "urls" in options else [options["path"]]

    def initialOffset(self) -> dict:
        return {url: 0 for url in self.urls}

    def latestOffset(self) -> dict:
        with ThreadPoolExecutor(LOOKS) as pool:
            return dict(zip(self.urls, pool.map(lambda url: line_end(url, 0, size_of(url)), self.urls), strict=True))

    def partitions(self, start: dict, end: dict) -> list[_Ranges]:
        """Ranges that begin and stop anywhere; a range has the lines that begin in it. Short ones share a task."""
        out, room = [], 0
        for url in self.urls:
            low, high = start.get(url, 0), end[url]
            for at in range(low, high, RANGE):
                stop = min(at + RANGE, high)
                if stop - at > room:
                    out.append(_Ranges())
                    room = RANGE
                out[-1].ranges.append((url, at, stop, high))
                room -= max(stop - at, RANGE // SHARED)
        return out

    def read(self, part: _Ranges) -> Iterator[tuple]:
        for url, start, stop, last in part.ranges:
            data = read_range(url, start - 1, stop) if start else b"\n" + read_range(url, 0, stop)
            begun = data.find(b"\n") + 1  # after the end of the line that began before
            if not begun or begun == len(data):
                continue
            at, data = start - 1 + begun, data[begun:]
            while not data.endswith(b"\n") and stop < last:  # the last line reaches into the next range
                more = read_range(url, stop, min(stop + TAIL, last))
                cut = more.find(b"\n") + 1
                data, stop = data + (more[:cut] if cut else more), stop + len(more)
            for line in data.split(b"\n")[:-1]:
                yield url, at, line.removesuffix(b"\r").decode(errors="replace")
                at += len(line) + 1

    def commit(self, end: dict) -> None:
        pass


class Lines(DataSource):
    """``spark.readStream.format("lines").load(url)``, or option ``urls`` with a JSON list: url, offset of the line's first byte, and line.

    URLs are http, https, or files that Arrow's file systems open. A line counts when its end is there; resources only grow.
    """

    @classmethod
    def name(cls) -> str:
        return "lines"

    def schema(self) -> str:
        return "url string, offset long, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)
