import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.functions import geometry as G
from loomline.functions import identity as I
from loomline.functions import signature as S
from loomline.functions import tensor as T


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


GOLDEN = [
    (512, 288, 14, 4, 147456, (504, 280, 180), (504, 280, 180), (504, 280, 180)),
    (512, 288, 16, 784, 1003520, (512, 288, 144), (512, 288, 144), (512, 288, 144)),
    (1500, 1000, 14, 3136, 1003520, (1204, 812, 1247), (1232, 812, 1276), (1204, 812, 1247)),
    (1080, 1920, 14, 3136, 1003520, (728, 1316, 1222), (756, 1344, 1296), (728, 1316, 1222)),
    (4000, 3000, 14, 3136, 1003520, (1148, 840, 1230), (1148, 868, 1271), (1148, 840, 1230)),
    (14, 14, 14, 3136, 1003520, (56, 56, 4), (56, 56, 4), (56, 56, 4)),
    (10, 2000, 14, 3136, 1003520, (28, 812, 29), (28, 1988, 71), (28, 1988, 71)),
    (13, 300, 14, 784, 1003520, (28, 140, 5), (28, 308, 11), (28, 308, 11)),
    (10, 2010, 14, 3136, 1003520, None, (28, 2016, 72), None),
]


@pytest.mark.parametrize("case", GOLDEN, ids=lambda c: f"{c[0]}x{c[1]}p{c[2]}")
def test_resize(spark, case):
    h, w, patch, low, high, *want = case
    out = {}
    for v in "ABC":
        rh, rw = G.resized(F.lit(h), F.lit(w), 2 * patch, low, high, v)
        t, gh, gw = G.grid(rh, rw, patch)
        out |= {f"{v}h": rh, f"{v}w": rw, f"{v}t": G.tokens(t, gh, gw, 2)}
    row = one(spark, **out)
    for v, x in zip("ABC", want):
        assert (row[f"{v}h"], row[f"{v}w"]) == (x[:2] if x else (None, None))
        assert x is None or row[f"{v}t"] == x[2]


URLS = [
    ("HTTPS://User:p@Example.COM:8443/a.jpg?x=1#f", "https://example.com:8443/a.jpg?x=1"), ("http://h", "http://h/"), ("http://h?", "http://h/"), ("http://h/p?#", "http://h/p"),
    ("ftp://h/x", None), ("http:///x", None), (None, None), ("http://h:080/x", "http://h:80/x"), ("http://H#frag", "http://h/"),
]


def test_urls(spark):
    rows = spark.createDataFrame(URLS, "u string, want string").select("want", I.canonical_http_url(F.col("u")).alias("got"), I.transport(F.col("u"), F.lit("")).alias("t"), I.transport(F.col("u"), F.lit("/x")).alias("p")).collect()
    assert all(r["got"] == r["want"] and r["p"] == "local_path" for r in rows)
    assert [r["t"] for r in rows][:5] == ["http"] * 4 + [None]


def test_data_urls(spark):
    u = F.col("u")
    df = spark.createDataFrame([("data:image/jpeg;base64,AAAA",), ("DATA:image/png;base64,AA==",), ("data:,",), ("data:x",), (None,), ("data:;base64, QUI= ",)], "u string")
    rows = df.select(I.data_url_mime(u).alias("m"), I.base64_size(u).alias("n"), I.is_data_url(u).alias("d")).collect()
    assert [r["m"] for r in rows] == ["image/jpeg", None, None, None, None, None]
    assert [r["n"] for r in rows] == [3, 1, 0, None, None, 2]
    assert [r["d"] for r in rows] == [True, True, False, False, False, False]


def test_paths_and_names(spark):
    row = one(
        spark, a=I.file_path(F.lit("file:///tmp/a%20b+c.jpg")), b=I.file_path(F.lit("/tmp/a.jpg")), c=I.file_path(F.lit("http://x/y")),
        d=I.mime(F.lit("http://x/y"), F.lit(None).cast("string"), F.lit("/a/b.JPG")), e=I.mime(F.lit("x"), F.lit("PNG"), F.lit("a.gif")), f=I.mime(F.lit("x"), F.lit(None).cast("string"), F.lit("a.zzz")),
        g=I.claimer_rank(F.lit("r::producer_rank=1::producer_rank=7")), h=I.claimer_rank(F.lit("r::producer_rank=-1")), i=I.claimer_rank(F.lit("r")),
        j=I.diagnostic_suffix(F.lit("--A b!")), k=I.diagnostic_suffix(F.lit("!!")), l=I.diagnostic_suffix(F.lit(None).cast("string")),
        m=I.cpu_set(F.lit("3-0, 8,x,8,")), n=I.cpu_set(F.lit("x")), o=I.base64_source_key(F.lit("req:abc"), F.lit(3)),
    )
    assert tuple(row) == ("/tmp/a b+c.jpg", "/tmp/a.jpg", None, "image/jpeg", "image/png", "image/unknown", 7, None, None, "a_b", "unknown", "none", [0, 1, 2, 3, 8], None, "base64:req:abc:image:3")


def test_signature(spark):
    text = S.build({"patch": 16, "rescale_factor": 1 / 255, "do_resize": True, "image_mean": (0.5, 0.25, 0.1)})
    m = S.parse(F.concat(text, F.lit("|junk|a=b=c|patch=20|bad=x")))
    row = one(spark, s=text, m=m, p=S.integer(m, "patch", 14), q=S.integer(m, "bad", 14), r=S.boolean(m, "do_resize", False), t=S.three(m, "image_mean", (0.0, 0.0, 0.0)), u=S.three(m, "a", (1.0, 1.0, 1.0)), z=S.integer(m, "none", 0))
    assert row["s"] == "patch=16|rescale_factor=0.00392156862745098|do_resize=1|image_mean=0.5,0.25,0.1"
    assert row["m"]["a"] == "b=c" and row["m"]["patch"] == "20"
    assert (row["p"], row["q"], row["r"], row["t"], row["u"], row["z"]) == (20, 14, True, [0.5, 0.25, 0.1], [1.0] * 3, 1)


def test_patches_are_a_bijection_and_match_the_formula(spark):
    for t, c, h, w, p, m in ((1, 3, 8, 8, 2, 2), (2, 3, 8, 12, 2, 1), (2, 1, 12, 12, 3, 2)):
        image = np.arange(t * c * h * w).reshape(t, c, h, w)
        got = T.patches(image, p, m)
        assert sorted(got.ravel()) == list(range(image.size))
        row, col = T.patch_position(F.col("id").cast("int"), t, c, h, w, p, m)
        for i, r, k in spark.range(image.size).select(F.col("id"), row, col).collect():
            assert got[r, k] == i


def test_resize_keeps_constants_and_sizes():
    image = np.full((9, 13, 3), 77, dtype=np.uint8)
    assert (T.resize(image, 4, 20) == 77).all() and T.resize(image, 4, 20).shape == (4, 20, 3)
    rng = np.random.default_rng(1).integers(0, 256, (5, 6, 3)).astype(np.uint8)
    assert (T.resize(rng, 5, 6) == rng).all()
    assert T.with_frames(np.zeros((3, 2, 2)), 2).shape == (2, 3, 2, 2)


def test_hosts_of_urls(spark):
    rows = ["http://[FE80::1%25tEst]:0042/a?", "HTTPS://u:p@[::1]", "http://[::1/x", "http://EX.com%Ab:7#f", "http://[]/x", "ftp://a/b", None, "http://a:b@C:80?q"]
    df = spark.createDataFrame([(u,) for u in rows], "u string")
    got = df.select(I.canonical_http_url(F.col("u")).alias("c"), I.http_source_key(F.col("u")).alias("k"), I.http_source_error(F.col("u")).alias("e"), I.transport_error(F.col("u"), F.lit(None).cast("string")).alias("t")).collect()
    assert [r["c"] for r in got] == ["http://fe80::1%25tEst:42/a", "https://::1/", None, "http://ex.com%Ab:7/", None, None, None, "http://c:80/?q"]
    assert all((r["e"] is None) == (r["k"] is not None) and (r["t"] is None) == (r["e"] is None) for r in got)
