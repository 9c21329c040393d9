import collections
import json
import os
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import duckdb
import pytest
from pyspark.sql import functions as F

from loomline.plans import texts
from loomline.plans.registry import SQL
from loomline.sources import lines, media


class Site:
    """A local host that counts connections and the requests in flight."""

    def __init__(self):
        site = self
        self.pages, self.connections, self.now, self.most, self.lock, self.asked = {}, 0, 0, 0, threading.Lock(), collections.Counter()

        class Handler(BaseHTTPRequestHandler):
            protocol_version = "HTTP/1.1"

            def setup(self):
                with site.lock:
                    site.connections += 1
                super().setup()

            def _answer(self, body):
                with site.lock:
                    site.now += 1
                    site.most = max(site.most, site.now)
                    site.asked[self.path] += 1
                if site.pages.get("slow"):
                    time.sleep(0.02)
                page, status, more = site.pages.get(self.path), 200, {}
                if page is None:
                    status, page = 404, b""
                elif isinstance(page, str):
                    status, more, page = 302, {"Location": page}, b""
                elif spec := self.headers.get("Range"):
                    a, z = spec.removeprefix("bytes=").split("-")
                    status, page = 206, page[int(a) : int(z) + 1]
                with site.lock:
                    site.now -= 1
                self.send_response(status)
                for k, v in more.items():
                    self.send_header(k, v)
                self.send_header("Content-Length", str(len(page)))
                self.end_headers()
                if body:
                    self.wfile.write(page)

            def do_GET(self):
                self._answer(True)

            def do_HEAD(self):
                self._answer(False)

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()


@pytest.fixture
def site():
    made = Site()
    yield made
    made.server.shutdown()


def test_fetch_by_host(spark, site):
    site.pages = {f"/p{i}": f"page {i}".encode() for i in range(60)} | {"/moved": "/p7", "/round": "/round", "slow": b"1"}
    names = [f"/p{i}" for i in range(60)] * 2 + ["/moved", "/gone", "/round"]
    rows = spark.createDataFrame([(i, site.url + n) for i, n in enumerate(names)] + [(998, "ftp://x/y"), (999, None)], "id long, u string").repartition(16)
    got = {int(r["key"]): (r["content"] and bytes(r["content"]), r["error"]) for r in media.fetch(rows, "id", "u", per_host=2).collect()}
    assert all(got[i] == (f"page {i % 60}".encode(), None) for i in range(120))
    assert got[120] == (b"page 7", None) and got[121] == (None, "OSError: HTTP status 404") and got[122] == (None, "OSError: too many redirects")
    assert got[998][1].startswith("ValueError") and 999 not in got
    assert site.most <= 2 and site.connections <= 2  # two lanes, one connection each, for 63 requests
    assert all(site.asked[f"/p{i}"] == 1 + (i == 7) for i in range(60))


def read(spark, path, *urls):
    spark.dataSource.register(lines.Lines)
    source = spark.readStream.format("lines").option("urls", json.dumps(urls)).load()
    q = source.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").trigger(once=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return sorted((r["url"][-2:], r["offset"], r["line"]) for r in spark.read.schema("url string, offset long, line string").parquet(f"{path}/out").collect())


def want(name, data):
    out, at = [], 0
    for line in data.split(b"\n")[:-1]:
        out.append((name, at, line.removesuffix(b"\r").decode()))
        at += len(line) + 1
    return out


def test_lines_resume_from_their_offset(spark, site, tmp_path):
    a, b = b"one\ntwo\r\n\nthr", b"x" * 70_000 + b"\n" + b"y\n" * 40
    site.pages = {"/a": a, "/b": b}
    (tmp_path / "c").write_bytes(b"file\nno end yet")
    urls = [f"{site.url}/a", f"{site.url}/b", str(tmp_path / "c")]
    assert read(spark, tmp_path, *urls) == sorted(want("/a", a) + want("/b", b) + want("/c", b"file\nno end yet"))
    site.pages["/a"] = a = a + b"ee\nfour\n"
    (tmp_path / "c").write_bytes(b"file\nno end yet, now\nlast\n")
    assert read(spark, tmp_path, *urls) == sorted(want("/a", a) + want("/b", b) + want("/c", b"file\nno end yet, now\nlast\n"))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64])
def test_ranges_have_each_line_once(tmp_path, monkeypatch, size):
    monkeypatch.setattr(lines, "RANGE", size)
    monkeypatch.setattr(lines, "TAIL", 2)
    data = b"\n\na\nbb\r\nccc ccc ccc ccc\n\nd\xc3\xa9\nend\n"
    (tmp_path / "f").write_bytes(data + b"open")
    url = str(tmp_path / "f")
    reader = lines._Reader({"path": url})
    end = reader.latestOffset()
    assert end == {url: len(data)}
    assert [(p[0][-2:], *p[1:]) for part in reader.partitions(reader.initialOffset(), end) for p in reader.read(part)] == want("/f", data)
    late = reader.partitions({url: 3}, end)
    assert [(p[0][-2:], *p[1:]) for part in late for p in reader.read(part)] == [w for w in want("/f", data) if w[1] >= 3]


def test_token_stream_from_lines(spark, site, tmp_path):
    say = lambda t: b"data: " + json.dumps({"choices": [{"delta": {"content": t}}]}).encode()
    site.pages = {"/s": b"\n\n".join([say("Hel"), say("lo"), b"data: [DONE]", say("late"), b""])}
    read(spark, tmp_path, f"{site.url}/s")
    rows = spark.read.parquet(f"{tmp_path}/out").select("url", F.col("offset").alias("seq"), F.col("offset").cast("double").alias("at"), "line")
    out = media.streamed(rows, "url").collect()
    assert [(r["tokens"], r["text"]) for r in out] == [(2, "Hello")]


def test_short_ranges_share_tasks(tmp_path):
    data = {}
    for i in range(300):
        (tmp_path / f"{i:03}").write_bytes(own := b"%d\n" % i * (i % 4))
        data[str(tmp_path / f"{i:03}")] = own
    reader = lines._Reader({"urls": json.dumps([*data, str(tmp_path / "none")])})
    parts = reader.partitions(reader.initialOffset(), end := reader.latestOffset())
    assert end == {u: len(d) for u, d in data.items()} | {str(tmp_path / "none"): 0}
    assert [(p[0][-3:], *p[1:]) for part in parts for p in reader.read(part)] == [w for u, d in data.items() for w in want(u[-3:], d)]
    assert len(parts) == 2  # of at most 128 ranges


def test_many_responses_share_files(spark, tmp_path, monkeypatch):
    (tmp_path / "sf").mkdir()
    rows = [(c, t, ["user", "assistant"][t % 2], f"{c}\t{t}\n\u00e9\r") for c in range(200) for t in range(4)]
    rows += [(None, 0, "assistant", "of none"), (None, 1, None, "x"), (-5, None, "assistant", "last"), (-5, 1, "assistant", "first "), (-6, 0, "assistant", None), (-6, 1, "assistant", ""), (-7, 0, "user", "only")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/sf/conversations.parquet")
    monkeypatch.setattr(texts, "new_path", lambda _: str(tmp_path / "made"))
    got = {tuple(r) for r in texts.response_lines(spark, f"{tmp_path}/sf").select("conv_id", "tokens", "text_sha256").collect()}
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/sf/conversations.parquet/*.parquet'")
    assert got == set(con.execute(SQL["response_lines"]).fetchall()) and len(got) == 204
    assert len([n for n in os.listdir(tmp_path / "made/in") if n[0] not in "._"]) <= 16


def test_no_responses(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert texts.response_lines(spark, str(tmp_path)).collect() == []
