"""Pixel operators on packed ARGB integers, in numpy: cut, subsample, orient, resample, mask, PNG in and out.

A row's `pixels` are little-endian 32-bit ARGB, unpremultiplied, row by row. Each row is one image: work is per row,
batches are Arrow's, nothing is shuffled. Whole images are decoded, so keep executors sized for the largest one.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.session import ship

IMAGE = "struct<width:int,height:int,pixels:binary>"
#: Reasons a crop gives no bytes.
REASONS = ("SourceUnreadable", "EmptyRegion", "DecodeFailed", "EncodeUnsupported", "EncodeFailed")
#: What a resampled crop's side is limited to.
MOST_SIDE = 32766


def grid(pixels: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(pixels, "<u4", width * height).reshape(height, width)


def packed(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a, "<u4").tobytes()


def from_channels(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """Spark's image rows (grey, BGR or BGRA bytes) as ARGB."""
    a = np.frombuffer(data, np.uint8, width * height * channels).reshape(height, width, channels).astype(np.uint32)
    b, g, r = (a[..., 0],) * 3 if channels == 1 else (a[..., 0], a[..., 1], a[..., 2])
    alpha = a[..., 3] if channels == 4 else np.uint32(255)
    return (alpha << 24) | (r << 16) | (g << 8) | b


def to_channels(a: np.ndarray) -> bytes:
    """ARGB as BGRA bytes."""
    return a.astype("<u4").tobytes()


def clip(region: tuple[int, int, int, int], width: int, height: int) -> tuple[int, int, int, int] | None:
    l, t, r, b = region  # noqa: E741
    l, t, r, b = max(l, 0), max(t, 0), min(r, width), min(b, height)  # noqa: E741
    return (l, t, r, b) if l < r and t < b else None


def crop(a: np.ndarray, region: tuple[int, int, int, int], sample: int = 1) -> np.ndarray | None:
    """The region's every n-th pixel; sides are divided and rounded down, to one at least. n is a power of two at most as asked."""
    at = clip(region, a.shape[1], a.shape[0])
    if at is None:
        return None
    l, t, r, b = at  # noqa: E741
    n = 1 << (max(1, sample).bit_length() - 1)
    return a[t:b:n, l:r:n][: max(1, (b - t) // n), : max(1, (r - l) // n)]


def orient(a: np.ndarray, orientation: int) -> np.ndarray:
    """Turned clockwise, then mirrored."""
    quarter, mirrored = {1: (0, 0), 2: (0, 1), 3: (2, 0), 4: (2, 1), 5: (1, 1), 6: (1, 0), 7: (3, 1), 8: (3, 0)}.get(orientation, (0, 0))
    a = np.rot90(a, -quarter)
    return np.fliplr(a) if mirrored else a


def bilinear(a: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Colours at float32 places; places outside take the edge's, halves round up."""
    h, w = a.shape
    x, y = np.clip(x.astype(np.float32), 0, w - 1), np.clip(y.astype(np.float32), 0, h - 1)
    x0, y0 = x.astype(np.int32), y.astype(np.int32)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = x - x0.astype(np.float32), y - y0.astype(np.float32)
    out = np.zeros(x.shape, np.uint32)
    for shift in (24, 16, 8, 0):
        p = [((a[j, i] >> shift) & 255).astype(np.float32) for j, i in ((y0, x0), (y0, x1), (y1, x0), (y1, x1))]
        top, bottom = p[0] + (p[1] - p[0]) * fx, p[2] + (p[3] - p[2]) * fx
        value = np.clip(np.floor((top + (bottom - top) * fy).astype(np.float64) + 0.5), 0, 255).astype(np.uint32)
        out |= value << shift
    return out


def _turn(degrees: float) -> tuple[np.float32, np.float32]:
    angle = float(np.float32(degrees) * np.float32(0.017453292))
    c, s = np.float32(np.cos(angle)), np.float32(np.sin(angle))
    zero = np.float32(1 / 4096)
    return (c if abs(c) >= zero else np.float32(0)), (s if abs(s) >= zero else np.float32(0))


def resample(a: np.ndarray, region: tuple, sample: int, image_size: tuple[int, int], content: tuple, frame: tuple, scale: float, offset: tuple[float, float], rotation: float, flip_h: bool, flip_v: bool) -> np.ndarray | None:
    """The frame's view through the transform; None where nothing needs resampling or the frame is empty.

    a: the decoded region of the image, subsampled by `sample`; content: where the image is drawn; all rectangles are
    (left, top, right, bottom).
    """
    f = np.float32
    if not (rotation or flip_h or flip_v) or not (frame[2] > frame[0] and frame[3] > frame[1]):
        return None
    cl, ct, cr, cb = map(f, content)
    per = f(image_size[0]) / (cr - cl) / f(scale) / f(sample)
    fw, fh = f(frame[2]) - f(frame[0]), f(frame[3]) - f(frame[1])
    w = int(np.clip(np.floor(float(fw * per) + 0.5), 1, MOST_SIDE))
    h = int(np.clip(np.floor(float(fh * per) + 0.5), 1, MOST_SIDE))
    vx = f(frame[0]) + (np.arange(w, dtype=f) + f(0.5)) * fw / f(w)
    vy = f(frame[1]) + (np.arange(h, dtype=f) + f(0.5)) * fh / f(h)
    px, py = (cl + cr) / f(2), (ct + cb) / f(2)
    cos, sin = _turn(rotation)
    kx, ky = f(-scale if flip_h else scale), f(-scale if flip_v else scale)
    out = np.empty((h, w), np.uint32)
    dx = (vx - f(offset[0]) - px)[None, :]
    for lo in range(0, h, 256):  # rows in bands, to bound memory
        dy = (vy[lo : lo + 256] - f(offset[1]) - py)[:, None]
        lx = px + (dx * cos + dy * sin) / kx
        ly = py + (dy * cos - dx * sin) / ky
        ix = (lx - cl) * f(image_size[0]) / (cr - cl)
        iy = (ly - ct) * f(image_size[1]) / (cb - ct)
        out[lo : lo + 256] = bilinear(a, (ix - f(region[0])) / f(sample) - f(0.5), (iy - f(region[1])) / f(sample) - f(0.5))
    return out


def coverage(shape: str, width: int, height: int, radius: float = 0.0) -> np.ndarray | None:
    """How much of each pixel lies in the shape, with an edge one pixel soft; None for shapes that cut nothing."""
    f = np.float32
    x, y = (np.arange(width, dtype=f) + f(0.5))[None, :], (np.arange(height, dtype=f) + f(0.5))[:, None]
    w, h = f(width), f(height)
    if shape == "Circle":
        nx, ny = (x - w / 2) / (w / 2), (y - h / 2) / (h / 2)
        inside = (f(1) - np.sqrt(nx * nx + ny * ny)) * min(w, h) / 2
    elif shape == "RoundedRectangle":
        r = f(min(max(radius, 0.0), min(width, height) / 2))
        dx, dy = np.maximum(r - x, x - (w - r)), np.maximum(r - y, y - (h - r))
        edge = np.minimum(np.minimum(x, w - x), np.minimum(y, h - y))
        inside = np.where((dx > 0) & (dy > 0), r - np.sqrt(dx * dx + dy * dy), edge)
    else:
        return None
    return np.clip(inside + f(0.5), 0, 1).astype(f)


def mask(a: np.ndarray, shape: str, radius: float = 0.0) -> np.ndarray:
    """Alpha times coverage, rounded down; pixels outside are cleared."""
    cover = coverage(shape, a.shape[1], a.shape[0], radius)
    if cover is None:
        return a
    alpha = ((a >> 24).astype(np.float32) * cover).astype(np.uint32)
    cut = np.where(cover <= 0, np.uint32(0), (alpha << 24) | (a & 0xFFFFFF))
    return np.where(cover >= 1, a, cut)


def corner_radius(radius_dp: float, density: float, frame_width: float, out_width: int) -> float:
    """A radius on the screen, in output pixels."""
    base = radius_dp * density
    return base if frame_width <= 0 or out_width <= 0 else base * out_width / frame_width


def has_alpha(a: np.ndarray) -> bool:
    return bool((a >> 24 != 255).any())


def encode_png(a: np.ndarray) -> bytes:
    """RGBA, eight bits, no filter."""
    h, w = a.shape
    rgba = np.stack([(a >> s) & 255 for s in (16, 8, 0, 24)], axis=-1).astype(np.uint8)
    raw = np.zeros((h, 1 + 4 * w), np.uint8)
    raw[:, 1:] = rgba.reshape(h, 4 * w)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + chunk(b"IEND", b"")


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        return np.add.accumulate(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
    out, up = bytearray(line.tobytes()), above.tobytes()
    for i in range(len(out)):
        left = out[i - step] if i >= step else 0
        if kind == 3:
            guess = (left + up[i]) // 2
        else:
            corner = up[i - step] if i >= step else 0
            p = left + up[i] - corner
            a, b, c = abs(p - left), abs(p - up[i]), abs(p - corner)
            guess = left if a <= b and a <= c else up[i] if b <= c else corner
        out[i] = (out[i] + guess) & 255
    return np.frombuffer(bytes(out), np.uint8)


def decode_png(data: bytes, most_pixels: int = 200_000_000) -> np.ndarray | None:
    """An eight-bit PNG without interlacing as ARGB; None for anything else, or for more pixels than allowed."""
    if data[:8] != b"\x89PNG\r\n\x1a\n" or len(data) < 33:
        return None
    w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", data[16:29])
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if depth != 8 or channels is None or interlaced or not 0 < w * h <= most_pixels:
        return None
    at, body, palette, clear = 8, [], None, b""
    while at + 12 <= len(data):
        n, kind = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if kind == b"IDAT":
            body.append(part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = part
        at += 12 + n
    size = h * (1 + w * channels)
    try:
        raw = zlib.decompressobj().decompress(b"".join(body), size)
    except zlib.error:
        return None
    if len(raw) < size:
        return None
    rows = np.frombuffer(raw, np.uint8, size).reshape(h, 1 + w * channels)
    out, above = np.empty((h, w * channels), np.uint8), np.zeros(w * channels, np.uint8)
    for y in range(h):
        if rows[y, 0] > 4:
            return None
        above = out[y] = _unfilter(int(rows[y, 0]), rows[y, 1:], above, channels)
    px = out.reshape(h, w, channels).astype(np.uint32)
    alpha = np.full((h, w), 255, np.uint32)
    if colour == 3:
        if palette is None or px.max() >= len(palette):
            return None
        table = np.frombuffer(clear.ljust(len(palette), b"\xff")[: len(palette)], np.uint8).astype(np.uint32)
        alpha, rgb = table[px[..., 0]], palette[px[..., 0]].astype(np.uint32)
    elif channels <= 2:
        rgb = np.repeat(px[..., :1], 3, axis=2)
    else:
        rgb = px[..., :3]
    if channels in (2, 4):
        alpha = px[..., -1]
    return (alpha << 24) | (rgb[..., 0] << 16) | (rgb[..., 1] << 8) | rgb[..., 2]


def crop_one(content: bytes | None, orientation: int, region: tuple, sample: int = 1, view: dict | None = None, shape: str = "Rectangle", radius: float = 0.0, out_format: str = "PNG") -> tuple[bytes | None, int, int, str | None]:
    """(bytes, width, height, reason): region of the oriented image -> raw pixels -> oriented -> view -> mask -> guard -> PNG."""
    if not content:
        return None, 0, 0, "SourceUnreadable"
    a = decode_png(content)
    if a is None:
        return None, 0, 0, "DecodeFailed"
    a = orient(a, orientation)
    at = clip(region, a.shape[1], a.shape[0])
    if at is None:
        return None, 0, 0, "EmptyRegion"
    n = 1 << (max(1, sample).bit_length() - 1)
    part = crop(a, at, n)
    if view:
        seen = resample(part, at, n, (a.shape[1], a.shape[0]), **view)
        part = part if seen is None else seen
    if out_format != "JPEG":
        part = mask(part, shape, radius)
    if out_format != "PNG":  # no other encoder here; a JPEG would also flatten alpha silently
        return None, 0, 0, "EncodeUnsupported"
    return encode_png(part), part.shape[1], part.shape[0], None


def crop_images(df: DataFrame, key: list[str], content: str = "content", orientation: str = "orientation", region: str = "region", sample: str = "sample_size", shape: str = "Rectangle", radius: float = 0.0, out_format: str = "PNG") -> DataFrame:
    """key, bytes, width, height, reason of every row; a row without bytes says why."""
    ship(df.sparkSession)
    rows = df.select(*key, F.col(content).alias("_c"), F.col(orientation).cast("int").alias("_o"), *(F.col(region)[k].cast("int").alias(f"_{k}") for k in ("left", "top", "right", "bottom")), F.col(sample).cast("int").alias("_n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for c, o, l, t, r, b, n in zip(*(pdf[x] for x in ("_c", "_o", "_left", "_top", "_right", "_bottom", "_n")), strict=True):  # noqa: E741
                if pd.isna(l):
                    found.append((None, 0, 0, "EmptyRegion"))
                else:
                    found.append(crop_one(c, 1 if pd.isna(o) else int(o), (int(l), int(t), int(r), int(b)), 1 if pd.isna(n) else int(n), None, shape, radius, out_format))
            out = pdf[key].copy()
            out["bytes"], out["width"], out["height"], out["reason"] = (pd.Series([f[k] for f in found], index=out.index, dtype=object if k in (0, 3) else "int32") for k in range(4))
            yield out

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*key).schema.fields)
    return rows.mapInPandas(run, f"{fields}, bytes binary, width int, height int, reason string")


def load_crop(df: DataFrame, key: list[str], **how) -> DataFrame:
    """crop_images, with the input's own bytes where the crop is empty or fails."""
    done = crop_images(df, key, **how)
    own = df.select(*key, F.col(how.get("content", "content")).alias("_own"))
    return done.join(own, key).withColumn("bytes", F.coalesce("bytes", "_own")).drop("_own")
