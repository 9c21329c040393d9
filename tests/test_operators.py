import base64
import io
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.functions import images
from loomline.operators import images as pipeline
from loomline.operators import relational as R
from loomline.operators import validation as V
from loomline.sources import media
from loomline.streaming import lifecycle as L


def test_load_balance(spark):
    for sizes, ranks, order, loads in (([1000, 100, 200, 50, 64], 4, [0, 2, 1, 4, 3], [1000, 200, 100, 114]), ([16, 16, 16], 2, [0, 1, 2], [32, 16]), ([7, 7, 5, 5, 3], 2, [0, 1, 2, 3, 4], [15, 12])):
        got = spark.range(1).select(R.load_balance(F.array(*[F.lit(s).cast("long") for s in sizes]), ranks).alias("x")).first()["x"]
        assert got["loads"] == loads and [p["i"] for p in got["placed"]] == order


def test_sparse_summary_counts_missing_as_zero(spark):
    rows = spark.createDataFrame([("r", 1, "fetch", 3.0), ("r", 2, "fetch", 5.0), ("r", 1, "a", -4.0), ("r", 2, "b", 2.0), ("r", 1, "total", 8.0), ("r", 2, "total", 12.0)], "g string, row long, key string, value double")
    got = {r["key"]: (r["avg"], r["max"], r["sum"]) for r in R.sparse_summary(rows, "g", "row", "key", "value").collect()}
    assert got == {"fetch": (4.0, 5.0, 8.0), "a": (-2.0, 0.0, -4.0), "b": (1.0, 2.0, 2.0), "total": (10.0, 12.0, 20.0)}


def test_placement_of_long_groups(spark):
    draw = random.Random(11)
    kinds, owners = ["submit", "submit", "finish", None], [0, 1, 2, 3, -1, 9, None]
    rows = [(draw.choice([None, 1, 1, 2]), seq, draw.choice(kinds), draw.choice(owners)) for seq in range(3000)]
    assert sorted(map(tuple, R.placement(spark.createDataFrame(rows, "grp long, seq long, kind string, worker long"), 4).collect()), key=lambda r: r[1]) == _placed(rows, 4)
    n = 400_000  # a fold that copies what it has placed takes the square of that
    rows = spark.range(n).selectExpr("1L AS grp", f"{n} - id AS seq", "CASE WHEN id % 3 > 0 THEN 'submit' ELSE 'finish' END AS kind", "id % 4 AS worker")
    asked = [(1, n - i, "submit" if i % 3 else "finish", i % 4) for i in reversed(range(n))]
    began = time.monotonic()
    got = R.placement(rows, 4).toPandas().sort_values("seq")
    assert list(zip(got["grp"], got["seq"], got["worker"])) == _placed(asked, 4)
    assert time.monotonic() - began < 60


def _placed(rows, workers):
    """(grp, seq, worker) of each submit of rows in order of seq."""
    loads, out = {}, []
    for g, seq, kind, w in rows:
        own = loads.setdefault(g, [0] * workers)
        if kind == "submit":
            k = min(range(workers), key=lambda i: (own[i], i))
            own[k] += 1
            out.append((g, seq, k))
        elif w is not None and 0 <= w < workers:
            own[w] = max(own[w] - 1, 0)
    return out


def test_cache_snapshots(spark):
    c = spark.createDataFrame([(1, 1, 60), (1, 2, 40), (1, 3, 60), (2, 1, 101), (3, 1, 100)], "g long, used long, bytes long")
    assert sorted(tuple(r)[:2] for r in R.within_budget(c, "g", ["used"], "bytes", 100).collect()) == [(1, 2), (1, 3), (3, 1)]
    assert R.alive(c, "used", 2, F.lit(3)).count() == 2


def test_source_plan_rules(spark):
    rows = [("READY", True, None, None), ("QUEUED", True, "FALLBACK_CLAIMED", None), ("QUEUED", False, "READY", None), ("QUEUED", False, "FALLBACK_CLAIMED", 3), ("QUEUED", False, "FALLBACK_CLAIMED", None)]
    df = spark.createDataFrame(rows, "state string, claim_granted boolean, claim_state string, owner_rank int")
    got = [(r["decision"], r["producer_rank"], r["reason"]) for r in R.source_plan(df, 0).collect()]
    assert got == [("USE_SIDECAR", None, "ready_before_fallback"), ("FALLBACK", 0, "fallback_claim_granted"), ("USE_SIDECAR", None, "ready_after_claim_race"), ("FALLBACK", 3, "fallback_claim_already_owned"), (None, None, None)]
    assert [r["error"] for r in R.source_plan(df, 0).collect()] == [None] * 4 + ["fallback claim denied"]
    assert {r["reason"] for r in R.source_plan(df, 0, claim=False).collect()} == {"ready_before_fallback", "preview_requires_fallback"}


def test_retention_and_gates(spark):
    rows = spark.createDataFrame([(g, i) for g in range(5) for i in range(g * 10, g * 10 + 4)], "g long, i long")
    assert sorted(tuple(r) for r in R.newest(rows, "g", ["i"], 2, 2).collect()) == [(3, 32), (3, 33), (4, 42), (4, 43)]
    assert {r["g"] for r in R.all_match(rows, "g", F.col("i") != 20).collect()} == {0, 1, 3, 4}
    error = V.first_error((F.col("i") > 0, "zero"), (F.col("g") < 4, "group"))
    good, bad = V.quarantine(rows, error)
    assert good.count() == 15 and {(r["g"], r["error_code"]) for r in bad.collect()} == {(0, "zero"), (4, "group")}


def test_limits(spark):
    at = lambda e, w, h: spark.range(1).select(V.limits_error(F.lit(e), F.lit(w), F.lit(h), F.lit(3), 10, 100, 250)).first()[0]
    assert [at(10, 8, 10), at(11, 99, 99), at(1, 10, 11), at(1, 10, 10)] == [None, "encoded_bytes", "pixels_per_image", "decoded_bytes"]


def event(kind, epoch=None, claimer=None, request="r", idx=0, **more):
    none = dict.fromkeys(("item", "t_probe", "t_put", "error", "worker"))
    return none | {"event": kind, "epoch": epoch, "request": request, "idx": idx, "claimer": claimer, "ok": True} | more


def events(seed, n=400):
    rng = random.Random(seed)
    kinds = ["prepare", "started", "probed", "ready", "ready_put_done", "failed", "claim", "publish", "done", "evict", "fetch", "odd"]
    maybe = lambda x: x if rng.random() < 0.5 else None
    out = []
    for i in range(n):
        e = event(rng.choice(kinds), maybe(rng.randrange(1, 4)), maybe(rng.choice("ab")), rng.choice(["r", "r", "q"]), rng.choice([0, 0, 1]), ok=maybe(True), item=maybe(i), t_probe=maybe(float(i)), t_put=maybe(float(-i)), error=maybe("e"), worker=maybe(i % 4))
        key = rng.randrange(6)
        if key != 5 or e["event"] != "prepare":
            out.append((key, i, *(e[c.split()[0]] for c in L.EVENTS.split(", ")[2:])))
    return out


def test_transitions():
    e = L.Entry()
    done = lambda kind, epoch=None, claimer=None, **more: e.apply(event(kind, epoch, claimer, **more))
    assert not done("started", 1) and done("claim", None, "x") and e.state is None
    assert done("prepare", worker=3) and (e.state, e.epoch, e.worker, e.in_flight) == ("QUEUED", 1, 3, True)
    assert done("ready_put_done", 1, t_put=2.0) and done("started", 1) and not done("started", 1)
    assert done("probed", 1, item=7, t_probe=1.0) and (e.item, e.t_probe, e.t_put) == (7, 1.0, None)
    assert not done("ready", 2) and not e.in_flight  # the flight ends even where the result is out of date
    assert not done("ready", 1, ok=False) and e.state == "SIDECAR_RUNNING"
    assert done("ready", 1) and e.state == "READY" and e.cached and done("fetch")
    assert not done("claim", 1, "x")
    assert done("evict") and not done("fetch") and e.state == "EXPIRED"
    assert not done("claim", 2, "x") and not done("claim", 1, "x", request="q") and not done("claim", 1, "x", idx=1)  # stale handles
    assert done("claim", 1, "x") and e.epoch == 2 and not done("claim", 1, "x")
    assert done("claim", 2, "x") and not done("claim", 2, "y") and not done("ready", 2)
    assert not done("publish", 1, "x") and done("publish", 2, "x") and e.state == "FALLBACK_LOCAL_DONE" and done("fetch")
    assert done("prepare") and e.epoch == 3 and not e.payload
    assert done("ready", 3) and done("failed", 3, error="late") and e.error == "late"
    assert done("prepare", request="s") and (e.state, e.epoch, e.request, e.error) == ("READY", 4, "s", None)  # the cache has it


def test_fold_equals_entries(spark):
    for seed in range(6):
        rows = events(seed)
        want = {}
        columns = [c.split()[0] for c in L.EVENTS.split(", ")]
        for r in rows:
            want.setdefault(r[0], L.Entry()).apply(dict(zip(columns, r)))
        got = {r["key"]: tuple(r)[1:] for r in L.fold(spark.createDataFrame(rows, L.EVENTS)).collect()}
        assert got == {k: (e.state or "ABSENT", *L.astuple(e)[1:]) for k, e in want.items()}


def test_fold_equals_stream(spark, tmp_path):
    rows = events(1, 240)
    df = spark.createDataFrame(rows, L.EVENTS)
    want = {r["key"]: tuple(r) for r in L.fold(df).collect()}
    assert want[5][1] == "ABSENT"
    third = len(rows) // 3 + 1
    for k in range(3):
        spark.createDataFrame(rows[k * third : (k + 1) * third], L.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(L.EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = L.stream(source).writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {}
    for r in spark.table("states").collect():
        if r["key"] not in got or r["n_applied"] + r["n_dropped"] > sum(got[r["key"]][-2:]):
            got[r["key"]] = tuple(r)
    assert got == want


def test_media(spark, tmp_path):
    head = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xff\xc0\x00\x11\x08\x02\x00\x01\x20\x03"
    assert media.jpeg_size(head) == (288, 512) and media.jpeg_size(head[:12]) is None and media.jpeg_size(b"\xff\xd8\xff") is None
    for broken in (b"GIF89a", b"\xff\xd8\xff\xe0\x00\x01"):
        with pytest.raises(ValueError):
            media.jpeg_size(broken)
    frame = head[-9:]
    assert media.jpeg_size(b"\xff\xd8junk\xff\x01" + b"\xff" + frame[1:] if frame[0] == 0xFF else head) == (288, 512)  # bytes between segments
    assert media.jpeg_size(b"\xff\xd8\xff\xd9" + frame) is None  # nothing after the end of the image
    df = spark.createDataFrame([(1, bytearray(head)), (2, None), (3, bytearray(b"")), (4, bytearray(b"GIF89a")), (5, bytearray(images.encode_png(np.zeros((5, 7, 3), dtype=np.uint8))))], "id long, content binary")
    got = {r["key"]: tuple(r)[1:] for r in media.probe_jpeg(df, "id").collect()}
    assert got["1"] == (288, 512, None) and got["2"] == got["3"] == (None, None, None) and got["5"] == (7, 5, None) and got["4"][2].startswith("ValueError")
    assert media.probe_base64("data:image/jpeg;base64," + base64.b64encode(head).decode(), 8) == (288, 512)
    urls = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id long, u string")

    def get(u, headers, timeout):
        if u == "b":
            raise OSError("no")
        return f"{u}{headers}{timeout}".encode()

    got = {r["key"]: (r["content"] and bytes(r["content"]), r["error"]) for r in media.fetch(urls, "id", "u", get=get).collect()}
    assert got == {"1": (b"a[]30000", None), "2": (b"a[]30000", None), "3": (None, "OSError: no")}
    urls = spark.createDataFrame([(1, "a", [("k", "v"), ("k", "w")], 5), (2, "a", None, None)], "id long, u string, h array<struct<name: string, value: string>>, t int")
    got = {r["key"]: bytes(r["content"]).decode() for r in media.fetch(urls, "id", "u", get=get, headers="h", timeout="t").collect()}
    assert got == {"1": "a[('k', 'v'), ('k', 'w')]5", "2": "a[]30000"}
    coded = media.data_url_bytes(spark.createDataFrame([("data:;base64,QUI=",), ("x",)], "u string"), "u").collect()
    assert [r["content"] and bytes(r["content"]) for r in coded] == [b"AB", None]
    t = spark.createDataFrame([("k", 1, [3, 4], "float32", 48, [float(i) for i in range(12)]), ("j", 1, [3, 5], "float32", 60, [0.0])], "cache_key string, epoch int, shape array<int>, dtype string, nbytes long, values array<float>")
    media.write_tensors(t, f"{tmp_path}/t")
    back = media.read_tensors(spark, f"{tmp_path}/t")
    assert {r["cache_key"]: (r["error"], r["nbytes"]) for r in back.collect()} == {"k": (None, 48), "j": ("shape", 60)}
    assert [r["cache_key"] for r in media.drop_evicted(back, t.where("cache_key = 'j'")).collect()] == ["k"]
    out = io.BytesIO()
    np.save(out, np.arange(6, dtype=np.float32).reshape(2, 3))
    raw = np.arange(6, dtype=np.float32).tobytes()
    files = [("a", out.getvalue(), "npy", [2, 3], "float32", 24), ("b", raw, "raw", [2, 3], "float32", 24), ("c", raw[:-1], "raw", [2, 3], "float32", 24), ("d", out.getvalue(), "npy", [3, 2], "float32", 24), ("e", raw, "raw", [2, 3], "float32", 20)]
    got = {r["path"]: (r["values"], r["error"]) for r in media.load_tensors(spark.createDataFrame(files, "path string, content binary, format string, shape array<int>, dtype string, nbytes long")).collect()}
    assert got["a"] == got["b"] == ([0.0, 1.0, 2.0, 3.0, 4.0, 5.0], None)
    assert [got[k][1] for k in "cde"] == ["ValueError: file size", "ValueError: shape", "ValueError: nbytes"]
    assert media.markdown(spark.createDataFrame([(1, 2.0, "a|b")], "x long, y double, z string")).splitlines()[2] == "| 1 | 2.00 | a\\|b |"


def _filtered_png(pixels, kinds):
    """A PNG whose rows use the given filters, made byte by byte."""
    import struct
    import zlib

    h, w, n = pixels.shape
    flat = pixels.reshape(h, w * n).astype(int)
    raw = b""
    for y in range(h):
        row = [kinds[y % len(kinds)]]
        for i in range(w * n):
            left, up, corner = (flat[y, i - n] if i >= n else 0), (flat[y - 1, i] if y else 0), (flat[y - 1, i - n] if y and i >= n else 0)
            p = left + up - corner
            paeth = left if abs(p - left) <= abs(p - up) and abs(p - left) <= abs(p - corner) else up if abs(p - up) <= abs(p - corner) else corner
            row.append((flat[y, i] - [0, left, up, (left + up) // 2, paeth][row[0]]) % 256)
        raw += bytes(row)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_formats():
    import struct

    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 4):
        x = rng.integers(0, 256, (9, 7, n)).astype(np.uint8)
        assert (images.decode(_filtered_png(x, [0, 1, 2, 3, 4])) == x).all()
        assert images.to_rgb(x).shape == (9, 7, 3)
    x = rng.integers(0, 256, (3, 5, 3)).astype(np.uint8)
    assert (images.decode(images.encode_png(x)) == x).all()
    assert (images.decode(b"P6\n# note\n5 3\n255\n" + x.tobytes()) == x).all()
    rows = b"".join(r[:, ::-1].tobytes() + b"\0" for r in x[::-1])
    assert (images.decode(b"BM" + struct.pack("<IHHI", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 5, 3, 1, 24, 0, 0, 0, 0, 0, 0) + rows) == x).all()


def test_jpeg_files_and_local_pipeline(spark, tmp_path):
    x = np.zeros((60, 90, 3), dtype=np.uint8)
    x[:, :45, 0], x[:, 45:, 2] = 255, 255  # red left, blue right
    (tmp_path / "a.png").write_bytes(images.encode_png(x))
    jvm = spark.sparkContext._jvm
    picture = jvm.javax.imageio.ImageIO.read(jvm.java.io.File(f"{tmp_path}/a.png"))
    jvm.javax.imageio.ImageIO.write(picture, "jpg", jvm.java.io.File(f"{tmp_path}/b.jpg"))
    got = {r["origin"][-5:]: r for r in pipeline.decode_files(spark, str(tmp_path)).collect()}
    assert (np.frombuffer(got["a.png"]["pixels"], dtype=np.uint8).reshape(60, 90, 3) == x).all()
    near = np.frombuffer(got["b.jpg"]["pixels"], dtype=np.uint8).reshape(60, 90, 3).astype(int)
    assert abs(near[:, :30] - x[:, :30]).max() < 12 and abs(near[:, 60:] - x[:, 60:]).max() < 12
    data = (tmp_path / "b.jpg").read_bytes()
    assert media.probe_bytes(data, 16) == (90, 60)
    rows = spark.createDataFrame([("ok", bytearray(images.encode_png(x))), ("broken", bytearray(b"no")), ("none", None), ("long", bytearray(images.encode_png(np.zeros((1, 300, 3), dtype=np.uint8))))], "k string, content binary")
    made = {r["key"]: r for r in pipeline.run_locally(rows, "k").collect()}
    ok = made["ok"]
    assert (ok["grid_t"], ok["grid_h"], ok["grid_w"], ok["tokens"], ok["shape"], ok["nbytes"]) == (1, 4, 6, 6, [24, 1176], 24 * 1176 * 4)
    assert abs(ok["mean"] + 1 / 3) < 0.02 and len(ok["values"]) == 24 * 1176
    assert all(made[k]["error"] and made[k]["values"] is None for k in ("broken", "none", "long"))


def test_same_sides_in_numpy_and_spark(spark):
    from loomline.functions import geometry

    sizes = [(h, w) for h in (1, 13, 60, 500, 1500, 4000) for w in (1, 27, 300, 1000, 3000)]
    df = spark.createDataFrame(sizes, "h int, w int")
    a, b = geometry.resized(F.col("h"), F.col("w"), 28, 3136, 1_003_520)
    for r in df.select("h", "w", a.alias("a"), b.alias("b")).collect():
        try:
            assert images.sides(r["h"], r["w"], 28, 3136, 1_003_520) == (r["a"], r["b"])
        except ValueError:
            assert r["a"] is None
