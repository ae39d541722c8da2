"""Declared orientation from JPEG, WebP, HEIF and AVIF bytes, in one Arrow-batched function.

Every reader is total: malformed, hostile or truncated bytes mean upright (1). Every loop moves forward by at least a
header a turn and is bounded by the bytes given.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelmill.functions.headers import AVIF_BRANDS, HEIF_BRANDS

EXIF = b"Exif\0\0"


def _u(data: bytes, at: int, n: int, order: str = "big") -> int | None:
    """n bytes (0 to 8) as a number; nothing past the end."""
    if at < 0 or n < 0 or at + n > len(data):
        return None
    return int.from_bytes(data[at : at + n], order)


def tiff_orientation(data: bytes, start: int = 0) -> int | None:
    """Tag 0x0112 of the first directory of the block that begins at start, if it is one short of 1 to 8."""
    order = {b"II": "little", b"MM": "big"}.get(data[start : start + 2]) if start >= 0 else None
    if order is None or _u(data, start + 2, 2, order) != 42:
        return None
    at = _u(data, start + 4, 4, order)
    count = _u(data, start + at, 2, order) if at is not None else None
    for k in range(count or 0):
        entry = start + at + 2 + 12 * k
        tag = _u(data, entry, 2, order)
        if tag is None:
            return None
        if tag == 0x0112:
            if _u(data, entry + 2, 2, order) != 3 or _u(data, entry + 4, 4, order) != 1:
                return None
            value = _u(data, entry + 8, 2, order)
            return value if value is not None and 1 <= value <= 8 else None
    return None


def jpeg_orientation(data: bytes) -> int | None:
    """The first Exif segment before the scan that can be read; others, and markers that stand alone, are passed over."""
    at, found = 2, None
    while found is None and at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
        elif marker == 0x01 or 0xD0 <= marker <= 0xD9:
            at += 2
        else:
            length = _u(data, at + 2, 2)
            if length < 2:
                return None
            if marker == 0xE1 and data.startswith(EXIF, at + 4):
                found = tiff_orientation(data, at + 4 + len(EXIF))
            at += 2 + length
    return found


def webp_orientation(data: bytes) -> int | None:
    """The first EXIF chunk that can be read; chunks are padded to even sizes, and the identifier may be there or not."""
    at, found = 12, None
    while found is None and at + 8 <= len(data):
        size = _u(data, at + 4, 4, "little")
        if data.startswith(b"EXIF", at):
            found = tiff_orientation(data, at + 8 + len(EXIF) * data.startswith(EXIF, at + 8))
        at += 8 + size + (size & 1)
    return found


def boxes(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, first byte of the body, end) of each box; size 0 runs to the end, size 1 has 64 bits."""
    while start + 8 <= end:
        size, head = _u(data, start, 4), 8
        if size == 1:
            size, head = _u(data, start + 8, 8), 16
        elif size == 0:
            size = end - start
        if size is None or size < head or start + size > end:
            return
        yield data[start + 4 : start + 8], start + head, start + size
        start += size


def _child(data: bytes, kind: bytes, start: int, end: int) -> tuple[int, int] | None:
    return next(((a, b) for k, a, b in boxes(data, start, end) if k == kind), None)


#: (clockwise degrees, mirrored) -> orientation.
_BY_TURN = {(0, False): 1, (0, True): 2, (180, False): 3, (180, True): 4, (90, True): 5, (90, False): 6, (270, True): 7, (270, False): 8}


def compose(steps: list[tuple[str, int]]) -> int:
    """Turns (anticlockwise quarter turns) and mirrors (axis 0: top and bottom change places), in order, as one orientation."""
    degrees, mirrored = 0, False
    for kind, value in steps:
        if kind == "irot":
            clockwise = (360 - 90 * (value & 3)) % 360
            degrees = (degrees - clockwise if mirrored else degrees + clockwise) % 360
        else:
            degrees = degrees if value & 1 else (degrees + 180) % 360
            mirrored = not mirrored
    return _BY_TURN[degrees % 360, mirrored]


def heif_orientation(data: bytes) -> int | None:
    """The container's turns and mirrors if it declares any, else its Exif item."""
    meta = _child(data, b"meta", 0, len(data))
    if meta is None:
        return None
    start, end = meta[0] + 4, meta[1]
    iprp = _child(data, b"iprp", start, end)
    ipco = iprp and _child(data, b"ipco", *iprp)
    steps = [(k.decode(), data[a]) for k, a, b in boxes(data, *ipco) if k in (b"irot", b"imir") and a < b] if ipco else []
    if steps:
        return compose(steps)
    return _exif_item(data, start, end)


def _exif_item(data: bytes, start: int, end: int) -> int | None:
    iinf, iloc = _child(data, b"iinf", start, end), _child(data, b"iloc", start, end)
    if iinf is None or iloc is None:
        return None
    a, b = iinf
    wide = data[a] if a < b else 0
    wanted = None
    for kind, x, _ in boxes(data, a + (6 if wide == 0 else 8), b):
        version = data[x] if x < len(data) else 0
        if kind == b"infe" and version >= 2:
            n = 2 if version == 2 else 4
            if data[x + 4 + n + 2 : x + 4 + n + 6] == b"Exif":
                wanted = _u(data, x + 4, n)
                break
    if wanted is None:
        return None
    a, b = iloc
    version, sizes = _u(data, a, 1), _u(data, a + 4, 2)
    if version is None or version > 2 or sizes is None:
        return None
    offset_n, length_n, base_n, index_n = (sizes >> 12) & 15, (sizes >> 8) & 15, (sizes >> 4) & 15, (sizes & 15 if version else 0)
    id_n = 2 if version < 2 else 4
    count, at = _u(data, a + 6, id_n), a + 6 + id_n
    if max(offset_n, length_n, base_n, index_n) > 8:
        return None
    for _ in range(min(count or 0, len(data))):
        if at >= b:
            return None
        item = _u(data, at, id_n)
        at += id_n
        method = 0
        if version:
            method = (_u(data, at, 2) or 0) & 15
            at += 2
        at += 2
        base, extents = _u(data, at, base_n), _u(data, at + base_n, 2)
        at += base_n + 2
        if item is None or base is None or extents is None:
            return None
        if item == wanted and extents:
            offset, length = _u(data, at + index_n, offset_n), _u(data, at + index_n + offset_n, length_n)
            if offset is None or length is None:
                return None
            origin = 0
            if method == 1:
                idat = _child(data, b"idat", start, end)
                if idat is None:
                    return None
                origin = idat[0]
            elif method:
                return None
            first = origin + base + offset
            return _exif_block(data[first : first + length if length else len(data)])
        at += extents * (index_n + offset_n + length_n)
    return None


def _exif_block(block: bytes) -> int | None:
    """At the declared TIFF offset, else behind an identifier."""
    skip = _u(block, 0, 4)
    found = tiff_orientation(block, 4 + skip) if skip is not None else None
    if found is None and block.startswith(EXIF, 4):
        found = tiff_orientation(block, 4 + len(EXIF))
    return found


def _heif_brand(data: bytes) -> bool:
    """The first box names a still-image brand, as major or compatible one."""
    size = _u(data, 0, 4)
    if size is None or data[4:8] != b"ftyp":
        return False
    end = min(size, len(data))
    brands = {data[8:12], *(data[k : k + 4] for k in range(16, end - 3, 4))}
    return any(b.encode() in brands for b in HEIF_BRANDS + AVIF_BRANDS)


def read_orientation(data: bytes | None) -> int:
    """1 to 8, by the bytes' own format; formats that declare none, and unknown ones, are upright."""
    found = None
    if data:
        if data[:2] == b"\xff\xd8":
            found = jpeg_orientation(data)
        elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            found = webp_orientation(data)
        elif _heif_brand(data):
            found = heif_orientation(data)
    return found or 1


@F.pandas_udf(T.IntegerType())
def _read(content: pd.Series) -> pd.Series:
    return pd.Series([read_orientation(None if c is None else bytes(c)) for c in content], dtype="int32")


def orientation_of(content: Column) -> Column:
    """The declared orientation; formats that cannot declare one never reach Python as bytes."""
    two = F.substring(content, 1, 2)
    may = (two == F.lit(b"\xff\xd8")) | (F.substring(content, 1, 4) == F.lit(b"RIFF")) | (F.substring(content, 5, 4) == F.lit(b"ftyp"))
    return F.coalesce(_read(F.when(may, content)), F.lit(1))
