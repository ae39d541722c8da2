"""Image format and size from header bytes: total functions that answer null where the bytes say nothing.

Native for formats with fixed places; the JPEG marker walk is one Arrow-batched function that sees JPEG rows only.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelmill.functions.binary import ascii_of, be, holds, is_ascii, le, let, narrow, u8

#: Signatures, brands, and what a format can do.
PNG_SIGNATURE = bytes([0x89, 0x50, 0x4E, 0x47, 0x0D, 0x0A, 0x1A, 0x0A])
HEIF_BRANDS = ["heic", "heix", "heim", "heis", "hevc", "hevx", "hevm", "hevs", "mif1", "msf1"]
AVIF_BRANDS = ["avif", "avis"]
REGION_FORMATS = ["JPEG", "PNG", "WEBP", "HEIF", "RAW"]
HEADER_BYTES = 128 * 1024

SIZE = "struct<width:int,height:int>"
PROBE = T.StructType([T.StructField("format", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])


def header(content: Column, most: int = HEADER_BYTES) -> Column:
    return F.substring(content, 1, most)


def _result(fmt: str, width: Column, height: Column) -> Column:
    """Sizes count together, if both are above zero."""
    ok = (width > 0) & (height > 0)
    w, h = F.when(ok, width.cast("int")), F.when(ok, height.cast("int"))
    return F.struct(F.lit(fmt).alias("format"), w.alias("width"), h.alias("height"))


def probe_png(c: Column) -> Column:
    w, h = narrow(be(c, 16, 4)), narrow(be(c, 20, 4))
    is_png = F.coalesce(F.substring(c, 1, 8) == F.lit(PNG_SIGNATURE), F.lit(False)) & is_ascii(c, 12, "IHDR")
    return F.when(is_png & w.isNotNull() & h.isNotNull(), _result("PNG", w, h))


def probe_gif(c: Column) -> Column:
    w, h = le(c, 6, 2), le(c, 8, 2)
    is_gif = is_ascii(c, 0, "GIF87a") | is_ascii(c, 0, "GIF89a")
    return F.when(is_gif & w.isNotNull() & h.isNotNull(), _result("GIF", w, h))


def probe_webp(c: Column) -> Column:
    """Lossy, lossless and extended files; any other chunk is WebP of no known size."""
    low14 = F.lit(0x3FFF)
    sync = (u8(c, 23) == 0x9D) & (u8(c, 24) == 0x01) & (u8(c, 25) == 0x2A)
    lossy = lambda at: F.when(sync, le(c, at, 2).bitwiseAND(low14))
    packed = F.when(u8(c, 20) == 0x2F, narrow(le(c, 21, 4)))
    kind = lambda name: is_ascii(c, 12, name)
    w = F.when(kind("VP8 "), lossy(26)).when(kind("VP8L"), packed.bitwiseAND(low14) + 1).when(kind("VP8X"), le(c, 24, 3) + 1)
    h = F.when(kind("VP8 "), lossy(28)).when(kind("VP8L"), F.shiftright(packed, 14).bitwiseAND(low14) + 1).when(kind("VP8X"), le(c, 27, 3) + 1)
    return F.when(is_ascii(c, 0, "RIFF") & is_ascii(c, 8, "WEBP"), _result("WEBP", w, h))


def probe_isobmff(c: Column) -> Column:
    """The major brand and the compatible ones within the box; AVIF wins."""
    size = narrow(be(c, 0, 4))
    end = F.least(size, F.length(c))
    n = F.greatest(F.floor((end - 16) / 4).cast("int"), F.lit(0))
    more = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: ascii_of(c, k * 4 + 16, 4))).otherwise(F.array().cast("array<string>"))
    brands = F.concat(F.array(ascii_of(c, 8, 4)), more)
    among = lambda x, names: F.arrays_overlap(x, F.array(*map(F.lit, names)))
    fmt = let(brands, lambda x: F.when(F.coalesce(among(x, AVIF_BRANDS), F.lit(False)), "AVIF").when(F.coalesce(among(x, HEIF_BRANDS), F.lit(False)), "HEIF"))
    none = F.lit(None).cast("int")
    found = let(F.when(is_ascii(c, 4, "ftyp") & holds(c, 8, 4) & size.isNotNull(), fmt), lambda f: F.when(f.isNotNull(), F.struct(f.alias("format"), none.alias("width"), none.alias("height"))))
    return found


def jpeg_size(data: bytes) -> tuple[int | None, int | None] | None:
    """(width, height) of the first frame header; (None, None) for a JPEG that hides it; None for no JPEG."""
    if data[:2] != b"\xff\xd8":
        return None
    at, end = 2, len(data)
    while at + 3 < end:
        if data[at] != 0xFF:
            break
        marker = data[at + 1]
        if marker == 0xFF:  # fill byte
            at += 1
        elif marker == 0x01 or 0xD0 <= marker <= 0xD9:  # markers without a length
            at += 2
        else:
            length = int.from_bytes(data[at + 2 : at + 4], "big")
            if length < 2:
                break
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h, w = data[at + 5 : at + 7], data[at + 7 : at + 9]
                if len(w) == 2 and any(h) and any(w):
                    return int.from_bytes(w, "big"), int.from_bytes(h, "big")
                break
            at += 2 + length
    return None, None


@F.pandas_udf(PROBE)
def _jpeg(content: pd.Series) -> pd.DataFrame:
    found = [None if c is None else jpeg_size(bytes(c)) for c in content]
    return pd.DataFrame({
        "format": pd.Series([f and "JPEG" for f in found], dtype=object),
        "width": pd.Series([f and f[0] for f in found], dtype="Int32"),
        "height": pd.Series([f and f[1] for f in found], dtype="Int32"),
    })


def probe_jpeg(c: Column) -> Column:
    mine = F.coalesce(F.substring(c, 1, 2) == F.lit(b"\xff\xd8"), F.lit(False))
    found = _jpeg(F.when(mine, header(c)))
    return F.when(mine, found)


def probe(c: Column, jpeg: bool = True) -> Column:
    """struct(format, width, height), or null for bytes of no known format. jpeg=False keeps the plan free of Python."""
    first = [probe_png(c)] + ([probe_jpeg(c)] if jpeg else []) + [probe_gif(c), probe_webp(c), probe_isobmff(c)]
    return F.coalesce(*first)


def supports_region_decoding(fmt: Column) -> Column:
    return fmt.isin(*REGION_FORMATS)


def may_carry_alpha(fmt: Column) -> Column:
    return fmt != "JPEG"


def encode_quality(fmt: Column, lossy: int = 90, effort: int = 100) -> Column:
    """The quality an encoder is asked for; PNG has none but its fixed 100."""
    return F.when(fmt == "PNG", 100).when(fmt == "WEBP_LOSSLESS", effort).otherwise(lossy)


# Builders of headers, for tests and for queries over tables without images.


def hex_be(x: Column, n: int) -> Column:
    return F.lpad(F.hex(x.cast("long")), 2 * n, "0")


def hex_le(x: Column, n: int) -> Column:
    h = hex_be(x, n)
    return F.concat(*(F.substring(h, 2 * k - 1, 2) for k in range(n, 0, -1)))


def build_png(w: Column, h: Column) -> Column:
    return F.unhex(F.concat(F.lit(PNG_SIGNATURE.hex().upper() + "0000000D49484452"), hex_be(w, 4), hex_be(h, 4), F.lit("0806000000")))


def build_gif(w: Column, h: Column) -> Column:
    return F.unhex(F.concat(F.lit(b"GIF89a".hex()), hex_le(w, 2), hex_le(h, 2), F.lit("000000")))


def build_webp(kind: str, w: Column, h: Column) -> Column:
    riff = (b"RIFF" + bytes(4) + b"WEBP" + kind.encode() + bytes(4)).hex()
    if kind == "VP8 ":
        body = F.concat(F.lit("0000009D012A"), hex_le(w, 2), hex_le(h, 2))
    elif kind == "VP8L":
        body = F.concat(F.lit("2F"), hex_le((w - 1) + F.shiftleft((h - 1).cast("long"), 14), 4))
    else:
        body = F.concat(F.lit("00000000"), hex_le(w - 1, 3), hex_le(h - 1, 3))
    return F.unhex(F.concat(F.lit(riff), body))
