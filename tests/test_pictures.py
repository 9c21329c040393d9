import base64
import io

import numpy as np
import pytest

from loomline.functions import images
from loomline.operators import images as pipeline
from loomline.plans import pictures
from loomline.sources import blobs, heads, media


def stream(width, height, *segments, tail=b""):
    parts = b"".join(b"\xff\xe1" + (len(s) + 2).to_bytes(2, "big") + s for s in segments)
    return b"\xff\xd8" + parts + b"\xff\xc0\x00\x11\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\x03" + tail


class Counted:
    def __init__(self, content):
        self.content, self.asked = content, []

    def __call__(self, at, n):
        self.asked.append((at, n))
        return self.content[at : at + n]


def test_only_what_is_needed_is_read():
    data = stream(288, 512, b"\xff\xc0" * 20_000, b"x" * 65_000, tail=b"y" * 500_000)
    read = Counted(data)
    found, total = heads.sides(read, 64)
    assert found == (288, 512) and total == 64 * len(read.asked) and total <= 256  # the segments are jumped over
    assert heads.sides(heads.of_bytes(data), 8192) == ((288, 512), 8192 * 3)
    assert heads.sides(heads.of_stream(io.BytesIO(data)), 64)[0] == (288, 512)
    assert heads.sides(heads.of_bytes(data[:50_000]))[0] is None


@pytest.mark.parametrize("chunk", [1, 2, 3, 5, 7, 64, 8192])
def test_state_is_carried_over_chunks(chunk):
    for data in (stream(3, 70_000 % 65536, b"ab", b"", b"\xff" * 30), stream(1, 1), b"\xff\xd8junk\xff\xff\xff\x01" + stream(9, 8)[2:]):
        want = media.jpeg_size(data)
        coded = base64.b64encode(data).decode()
        assert heads.sides(heads.of_bytes(data), chunk)[0] == heads.sides(heads.of_base64(coded), chunk)[0] == heads.sides(heads.of_base64(coded.rstrip("=")), chunk)[0] == want
        assert heads.sides(heads.of_stream(io.BytesIO(data)), chunk)[0] == want
        lines = "\r\n".join(coded[i : i + 7] for i in range(0, len(coded), 7))
        assert heads.sides(heads.of_base64(lines), chunk)[0] == want
    assert heads.sides(heads.of_bytes(b"\xff\xd8\xff\xd9" + stream(1, 1)), chunk)[0] is None
    with pytest.raises(ValueError):
        heads.sides(heads.of_bytes(b"GIF89a"), chunk)


def test_files(spark, tmp_path):
    small, large = stream(5, 6), stream(288, 512, b"z" * 60_000, b"z" * 60_000, tail=b"t" * 1_000_000)
    png = images.encode_png(np.zeros((4, 9, 3), dtype=np.uint8))
    rows = spark.createDataFrame([("a", bytearray(small)), ("b", bytearray(large)), ("c", bytearray(png)), ("d", bytearray(b"no image")), ("e", None), ("f", bytearray(small))], "k string, content binary")
    named = {r["k"]: r["name"] for r in blobs.put(rows, "content", str(tmp_path / "in")).collect()}
    assert named["a"] == named["f"] and named["e"] is None
    assert sorted(p.name for p in (tmp_path / "in").iterdir()) == sorted({n for n in named.values() if n})
    blobs.put(rows, "content", str(tmp_path / "in"))  # a repeated write changes nothing
    spark.dataSource.register(heads.ImageHeads)
    found = spark.read.format("imageheads").option("chunk", 4096).load(str(tmp_path / "in"))
    got = {r["path"][-64:]: r for r in found.collect()}
    assert len(got) == 4
    assert (got[named["a"]]["width"], got[named["a"]]["height"]) == (5, 6)
    b = got[named["b"]]
    assert (b["width"], b["height"], b["bytes_read"], b["length"]) == (288, 512, 3 * 4096, len(large))
    assert (got[named["c"]]["width"], got[named["c"]]["height"], got[named["c"]]["error"]) == (9, 4, None)
    assert got[named["d"]]["error"].startswith("ValueError")
    (tmp_path / "none").mkdir()
    assert spark.read.format("imageheads").load(str(tmp_path / "none")).count() == 0


def test_urls_are_read_up_to_the_header(spark):
    data = {"a": stream(7, 8, tail=b"x" * 10**6), "b": b"GIF89a", "c": b"\xff\xd8\xff"}
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "gone"), (5, None)], "id long, u string")
    got = {r["key"]: tuple(r)[1:] for r in media.probe_urls(rows, "id", "u", lambda u: io.BytesIO(data[u])).collect()}
    assert got["1"] == (7, 8, 8192, None) and got["5"] == (None, None, 0, None)
    assert got["2"][3].startswith("ValueError: not") and got["3"][3] == "ValueError: no frame header" and got["4"][3].startswith("KeyError")


def test_jpeg_from_a_data_url_to_patches(spark, tmp_path):
    jvm = spark.sparkContext._jvm
    picture = jvm.java.awt.image.BufferedImage(288, 512, 5)
    paint = picture.createGraphics()
    paint.setColor(jvm.java.awt.Color(12, 34, 56))
    paint.fillRect(0, 0, 288, 512)
    jvm.javax.imageio.ImageIO.write(picture, "jpg", jvm.java.io.File(f"{tmp_path}/a.jpg"))
    data = (tmp_path / "a.jpg").read_bytes()
    url = "data:image/jpeg;base64," + base64.b64encode(data).decode()
    rows = spark.createDataFrame([("url", url), ("text", "data:;base64,bm8="), ("none", None), ("again", url)], "k string, u string")
    processor = images.Processor(patch=14, merge=2, temporal=1, min_pixels=4, max_pixels=288 * 512)
    made = {r["key"]: r for r in pipeline.run_locally(media.data_url_bytes(rows, "u"), "k", processor=processor).collect()}
    for k in ("url", "again"):
        r = made[k]
        assert r["error"] is None and (r["orig_h"], r["orig_w"]) == (512, 288)
        assert (r["grid_t"], r["grid_h"], r["grid_w"]) == (1, 36, 20)  # sides rounded to 504 x 280
    assert made["text"]["error"] and made["none"]["error"]
    whole = images.Processor(patch=16, merge=2, temporal=2, min_pixels=784, max_pixels=1_003_520)
    r = pipeline.run_locally(media.data_url_bytes(rows.where("k = 'url'"), "u"), "k", processor=whole).collect()[0]
    assert (r["grid_t"], r["grid_h"], r["grid_w"], r["tokens"]) == (1, 32, 18, 144) and list(r["shape"]) == [576, 1536]
    levels = np.asarray(r["values"]).reshape(576, 3, -1).mean(axis=(0, 2)) * 127.5 + 127.5
    assert abs(levels - [12, 34, 56]).max() < 3


def test_level_jpeg(spark, tmp_path):
    for level in (0, 1, 127, 128, 129, 200, 255):
        (tmp_path / f"{level}.jpg").write_bytes(pictures.level_jpeg(16, 40, level))
    for r in pipeline.decode_files(spark, str(tmp_path)).collect():
        assert (r["height"], r["width"]) == (16, 40)
        assert set(bytes(r["pixels"])) == {int(r["origin"].rsplit("/", 1)[1][:-4])}


def test_other_bytes_are_decoded_in_the_task(spark):
    x = np.arange(60 * 90 * 3, dtype=np.uint32).astype(np.uint8).reshape(60, 90, 3)
    rows = spark.createDataFrame([("pnm", bytearray(b"P6\n90 60\n255\n" + x.tobytes())), ("png", bytearray(images.encode_png(x)))], "k string, content binary")
    made = {r["key"]: r for r in pipeline.run_locally(rows, "k").collect()}
    assert made["pnm"]["values"] == made["png"]["values"] and made["png"]["error"] is None
    assert pipeline.run_locally(rows.where("k = 'x'"), "k").count() == 0
