"""Header and orientation readers on built bytes: right answers, and no failure on hostile ones."""

import random
import struct
import time

from pyspark.sql import functions as F

from pixelmill.functions import headers as H
from pixelmill.operators import exif


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)


def jpeg(w, h, marker=0xC0, before=b""):
    return b"\xff\xd8" + before + bytes([0xFF, marker]) + struct.pack(">HBHHB", 17, 8, h, w, 3)


def app(body, marker=0xE1):
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def tiff(value, order="<", kind=3, count=1, before=()):
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8)
    tags = [*before, struct.pack(order + "HHIHH", 0x0112, kind, count, value, 0)]
    return head + struct.pack(order + "H", len(tags)) + b"".join(tags) + bytes(4)


def box(kind, body):
    return struct.pack(">I", len(body) + 8) + kind + body


def heif(steps=(), brand=b"heic"):
    props = b"".join(box(k, bytes([v])) for k, v in steps)
    return box(b"ftyp", brand + bytes(4) + b"mif1") + box(b"meta", bytes(4) + box(b"iprp", box(b"ipco", props)))


CASES = {
    png(12000, 9000): ("PNG", 12000, 9000),
    png(0, 5): ("PNG", None, None),
    png(1 << 31, 5): None,
    png(3, 4)[:20]: None,
    jpeg(4000, 3000): ("JPEG", 4000, 3000),
    jpeg(7, 9, 0xC2, app(b"x" * 4096)): ("JPEG", 7, 9),
    jpeg(7, 9, 0xC4): ("JPEG", None, None),
    b"\xff\xd8\xff\xff\xff\xc0" + struct.pack(">HBHHB", 17, 8, 2, 3, 3): ("JPEG", 3, 2),
    b"\xff\xd8": ("JPEG", None, None),
    b"GIF89a" + struct.pack("<HH", 10, 20): ("GIF", 10, 20),
    b"GIF88a" + struct.pack("<HH", 10, 20): None,
    b"RIFF\0\0\0\0WEBPALPH": ("WEBP", None, None),
    b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + struct.pack("<I", 99 | 49 << 14): ("WEBP", 100, 50),
    b"RIFF\0\0\0\0WEBPVP8X" + bytes(8) + b"\x63\0\0\x31\0\0": ("WEBP", 100, 50),
    box(b"ftyp", b"mif1\0\0\0\0avif"): ("AVIF", None, None),
    box(b"ftyp", b"isom\0\0\0\0heic"): ("HEIF", None, None),
    box(b"ftyp", b"isom\0\0\0\0mp42"): None,
    b"": None,
    b"plain text, no image at all......": None,
}


def test_probe(spark):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(CASES)], "i int, c binary")
    got = {r.i: r.p for r in rows.select("i", H.probe(F.col("c")).alias("p")).collect()}
    for i, want in enumerate(CASES.values()):
        assert (got[i] and tuple(got[i])) == want, list(CASES)[i]


def test_orientations():
    for v in range(1, 9):
        for order in "<>":
            body = tiff(v, order, before=[struct.pack(order + "HHII", 0x0100, 4, 1, 7)])
            assert exif.tiff_orientation(body) == v and exif.read_orientation(body) == 1  # a bare block is no image
            assert exif.read_orientation(b"\xff\xd8" + app(b"http://ns.adobe.com/xap/1.0/\0") + app(exif.EXIF + body)) == v
            assert exif.read_orientation(b"RIFF\0\0\0\0WEBP" + b"ODD \1\0\0\0x\0" + b"EXIF" + struct.pack("<I", len(body)) + body) == v
    assert exif.tiff_orientation(tiff(9)) is None and exif.tiff_orientation(tiff(6, kind=4)) is None and exif.read_orientation(None) == 1
    # after the scan has begun, nothing counts
    assert exif.read_orientation(b"\xff\xd8" + app(b"", 0xDA) + app(exif.EXIF + tiff(6))) == 1


def test_walks_go_on_behind_what_cannot_be_read():
    bad, good = exif.EXIF + tiff(9), exif.EXIF + tiff(6)
    assert exif.read_orientation(b"\xff\xd8" + app(bad) + app(good)) == 6
    for alone in (0x01, 0xD0, 0xD7, 0xD8, 0xD9):
        assert exif.read_orientation(b"\xff\xd8" + bytes([0xFF, alone]) + app(good)) == 6
    chunk = lambda x: b"EXIF" + struct.pack("<I", len(x)) + x + b"\0" * (len(x) % 2)
    assert exif.read_orientation(b"RIFF\0\0\0\0WEBP" + chunk(bad) + chunk(b"odd") + chunk(good)) == 6
    assert exif.read_orientation(heif([(b"irot", 3)], b"isom")) == 6  # by a compatible brand
    assert exif.read_orientation(heif([(b"irot", 3)]).replace(b"heic", b"isom").replace(b"mif1", b"mp42")) == 1


def test_heif_turns():
    assert exif.read_orientation(heif([(b"irot", 1)])) == 8 and exif.read_orientation(heif([(b"irot", 3)])) == 6
    assert exif.read_orientation(heif([(b"imir", 1)])) == 2 and exif.read_orientation(heif([(b"imir", 0)])) == 4
    assert exif.read_orientation(heif([(b"irot", 3), (b"imir", 1)])) == 5
    assert exif.read_orientation(heif()) == 1


def test_hostile_bytes_end_soon():
    r = random.Random(3)
    seeds = [jpeg(4, 4, before=app(exif.EXIF + tiff(6))), heif([(b"irot", 1)]), b"RIFF\0\0\0\0WEBP" + bytes(64), tiff(3), png(4, 4)]
    began = time.time()
    for data in seeds:
        for at in range(0, len(data), 2):  # a huge value at every place
            for huge in (b"\xff\xff\xff\xff", b"\x7f\xff\xff\xff", bytes(4)):
                bad = data[:at] + huge + data[at + 4 :]
                assert 1 <= exif.read_orientation(bad) <= 8
                H.jpeg_size(bad)
        for _ in range(200):
            assert 1 <= exif.read_orientation(data + r.randbytes(64)) <= 8
    assert 1 <= exif.read_orientation(box(b"ftyp", b"heic" + bytes(4)) + struct.pack(">I", 1) * 40_000) <= 8
    assert time.time() - began < 20
