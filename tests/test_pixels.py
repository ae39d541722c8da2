"""Pixels: an asymmetric fixture through every step, files on disk, the cache and the gesture stream."""

import numpy as np
from pyspark.sql import functions as F

from pixelmill.functions import geometry as G
from pixelmill.operators import cache, pixels
from pixelmill.sources import images
from pixelmill.streaming import gestures


def quadrants(w=64, h=48):
    a = np.empty((h, w), np.uint32)
    a[: h // 2, : w // 2], a[: h // 2, w // 2 :], a[h // 2 :, : w // 2], a[h // 2 :, w // 2 :] = 0xFFFF0000, 0xFF00FF00, 0xFF0000FF, 0xFFFFFF00
    return a


def test_orientations():
    a = quadrants()
    names = {0xFFFF0000: "r", 0xFF00FF00: "g", 0xFF0000FF: "b", 0xFFFFFF00: "y"}
    look = lambda x: "".join(names[int(v)] for v in (x[0, 0], x[0, -1], x[-1, 0], x[-1, -1]))
    assert [look(pixels.orient(a, o)) for o in range(1, 9)] == ["rgby", "gryb", "ybgr", "byrg", "rbgy", "bryg", "ygbr", "gyrb"]
    assert pixels.orient(a, 6).shape == (64, 48)


def test_png_round_trip_and_refusals():
    a = quadrants()
    a[0, 0] = 0x80FF0000
    assert (pixels.decode_png(pixels.encode_png(a)) == a).all()
    assert pixels.decode_png(b"no") is None and pixels.decode_png(pixels.encode_png(a)[:60]) is None
    assert pixels.has_alpha(a) and not pixels.has_alpha(quadrants())


def test_crop_rounds_down():
    a = quadrants()
    assert pixels.crop(a, (10, 10, 31, 31), 4).shape == (5, 5) and pixels.crop(a, (10, 10, 31, 31), 5).shape == (5, 5)
    assert pixels.crop(a, (60, 40, 200, 200)).shape == (8, 4) and pixels.crop(a, (64, 0, 70, 5)) is None
    assert pixels.crop(a, (0, 0, 1, 1), 64).shape == (1, 1)


def test_resample_flip_is_exact():
    a = quadrants()
    view = dict(content=(0, 0, 64, 48), frame=(0, 0, 64, 48), scale=1.0, offset=(0, 0), rotation=0.0, flip_h=True, flip_v=False)
    assert (pixels.resample(a, (0, 0, 64, 48), 1, (64, 48), **view) == np.fliplr(a)).all()
    assert (pixels.resample(a, (0, 0, 64, 48), 1, (64, 48), **view | {"rotation": 180.0, "flip_h": False}) == a[::-1, ::-1]).all()
    assert pixels.resample(a, (0, 0, 64, 48), 1, (64, 48), **view | {"flip_h": False}) is None


def test_masks():
    a = quadrants()
    assert (pixels.mask(a, "Rectangle") == a).all() and (pixels.mask(a, "Custom") == a).all()
    for shape in ("Circle", "RoundedRectangle"):
        m = pixels.mask(a, shape, 16)
        assert m[0, 0] == 0 and m[24, 32] == a[24, 32] and pixels.has_alpha(m)


def test_files_to_crops(spark, tmp_path):
    for i, o in enumerate((1, 6)):
        (tmp_path / f"{i}.png").write_bytes(pixels.encode_png(quadrants()))
    (tmp_path / "bad.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    found = images.opened(images.files(spark, str(tmp_path), "*.png"))
    assert sorted(r.status for r in found.collect()) == ["Failed", "Ready", "Ready"]
    rows = found.withColumn("region", G.region(0, 0, 32, 24)).withColumn("sample_size", F.lit(1))
    got = {r.path.rsplit("/", 1)[1]: r for r in pixels.crop_images(rows, ["path"]).collect()}
    assert got["0.png"].width == 32 and (pixels.decode_png(bytes(got["0.png"].bytes)) == 0xFFFF0000).all()
    assert got["bad.png"].reason == "DecodeFailed"
    jpeg = pixels.crop_images(rows, ["path"], out_format="JPEG").collect()
    assert {r.reason for r in jpeg} == {"EncodeUnsupported", "DecodeFailed"}
    decoded = images.decoded(spark, str(tmp_path)).first()
    assert (pixels.grid(bytes(decoded.pixels), decoded.width, decoded.height) == quadrants()).all()


def test_cache_replay(spark):
    log = [(1, 0, "put", "a", 4), (1, 1, "put", "b", 4), (1, 2, "get", "a", 0), (1, 3, "put", "c", 4), (1, 4, "contains", "b", 0), (1, 5, "contains", "a", 0), (1, 6, "put", "d", 99)]
    df = spark.createDataFrame(log, "k int, at int, op string, name string, size int")
    got = [(r.at, r.hit, r.bytes, r.evicted) for r in cache.replay(df, "k", "at", "op", "name", "size", 8).orderBy("at").collect()]
    assert got == [(0, False, 4, 0), (1, False, 8, 0), (2, True, 8, 0), (3, False, 8, 1), (4, False, 8, 1), (5, True, 8, 1), (6, False, 0, 4)]


def test_gestures_stream_like_batch(spark, tmp_path):
    rows = [(1, 0, "tap", 5.0, 5.0, 0.0), (1, 100, "tap", 6.0, 5.0, 0.0), (1, 900, "drag", 3.0, 4.0, 0.0), (2, 0, "pinch", 0.0, 0.0, 30.0)]
    df = spark.createDataFrame(rows, "session long, ms long, kind string, x double, y double, value double")
    want = sorted(map(tuple, gestures.sessions(df).collect()))
    assert want == [(1, 3, 1, 1, 3.0, 4.0, 2.0), (2, 1, 0, 0, 0.0, 0.0, 10.0)]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = gestures.sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.outputMode("update").format("memory").queryName("gestures").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    assert sorted(map(tuple, spark.table("gestures").collect())) == want
