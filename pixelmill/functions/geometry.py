"""Points, rectangles, view transforms and coordinate spaces as float32 column expressions.

The contract is single-precision arithmetic: each operation rounds to float. Spark widens quotients and mixed
products to double, so each is cast back here. Comparisons with NaN are false in the contract and true in Spark, so
finiteness is asked first. Steps that use a value often bind it once with let(); plans grow in proportion to the steps.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelmill.functions.binary import let

#: Fixed values.
SNAP_DEGREES, NEARLY_ZERO, RADIANS, SLACK = 5.0, 1.0 / 4096.0, 0.017453292, 0.05


def f32(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def div(a: Column, b: Column) -> Column:
    """a / b as a float; by zero, null: not a finite number."""
    return F.try_divide(f32(a), f32(b)).cast("float")


def finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def point(x: Column, y: Column) -> Column:
    return F.struct(f32(x).alias("x"), f32(y).alias("y"))


def rect(left, top, right, bottom) -> Column:
    return F.struct(f32(left).alias("left"), f32(top).alias("top"), f32(right).alias("right"), f32(bottom).alias("bottom"))


def add(a: Column, b: Column) -> Column:
    return point(a["x"] + b["x"], a["y"] + b["y"])


def subtract(a: Column, b: Column) -> Column:
    return point(a["x"] - b["x"], a["y"] - b["y"])


def scaled(a: Column, k) -> Column:
    return point(a["x"] * f32(k), a["y"] * f32(k))


def sane(p: Column) -> Column:
    zero = f32(0)
    return point(F.when(finite(p["x"]), p["x"]).otherwise(zero), F.when(finite(p["y"]), p["y"]).otherwise(zero))


def close(a: Column, b: Column, tolerance: float) -> Column:
    return (F.abs(a["x"] - b["x"]) <= f32(tolerance)) & (F.abs(a["y"] - b["y"]) <= f32(tolerance))


def width(r: Column) -> Column:
    return r["right"] - r["left"]


def height(r: Column) -> Column:
    return r["bottom"] - r["top"]


def center(r: Column) -> Column:
    return point((r["left"] + r["right"]) * f32(0.5), (r["top"] + r["bottom"]) * f32(0.5))


def is_finite(r: Column) -> Column:
    return finite(r["left"]) & finite(r["top"]) & finite(r["right"]) & finite(r["bottom"])


def is_empty(r: Column) -> Column:
    """True where a side is not above the other, NaN included."""
    ordered = lambda a, b: F.coalesce(~F.isnan(a) & ~F.isnan(b) & (b > a), F.lit(False))
    return ~(ordered(r["left"], r["right"]) & ordered(r["top"], r["bottom"]))


def usable(r: Column) -> Column:
    return is_finite(r) & ~is_empty(r)


def corners(r: Column) -> Column:
    return F.array(point(r["left"], r["top"]), point(r["right"], r["top"]), point(r["right"], r["bottom"]), point(r["left"], r["bottom"]))


def inflate(r: Column, by) -> Column:
    d = f32(by)
    return rect(r["left"] - d, r["top"] - d, r["right"] + d, r["bottom"] + d)


def translate(r: Column, by: Column) -> Column:
    return rect(r["left"] + by["x"], r["top"] + by["y"], r["right"] + by["x"], r["bottom"] + by["y"])


def contains_point(r: Column, p: Column) -> Column:
    return finite(p["x"]) & finite(p["y"]) & p["x"].between(r["left"], r["right"]) & p["y"].between(r["top"], r["bottom"])


def contains(outer: Column, inner: Column) -> Column:
    return (inner["left"] >= outer["left"]) & (inner["top"] >= outer["top"]) & (inner["right"] <= outer["right"]) & (inner["bottom"] <= outer["bottom"])


def from_center(c: Column, w: Column, h: Column) -> Column:
    a, b = f32(w) * f32(0.5), f32(h) * f32(0.5)
    return rect(c["x"] - a, c["y"] - b, c["x"] + a, c["y"] + b)


def bounding(points: Column) -> Column:
    """The box of an array of points; no points, the zero box."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.when(F.size(points) > 0, rect(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))).otherwise(rect(0, 0, 0, 0))


def fit_inside(w: Column, h: Column, into: Column) -> Column:
    """Content of w by h, as large as `into` allows, centred."""
    ok = finite(w) & finite(h) & (w > 0) & (h > 0) & usable(into)
    k = F.least(div(width(into), w), div(height(into), h))
    middle = F.when(is_finite(into), center(into)).otherwise(point(f32(0), f32(0)))
    return F.when(ok, let(k, lambda s: from_center(center(into), f32(w) * s, f32(h) * s))).otherwise(let(middle, lambda m: rect(m["x"], m["y"], m["x"], m["y"])))


# Integer regions, half open


def region(left, top, right, bottom) -> Column:
    as_int = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("int")
    return F.struct(as_int(left).alias("left"), as_int(top).alias("top"), as_int(right).alias("right"), as_int(bottom).alias("bottom"))


def region_of(w: Column, h: Column) -> Column:
    return region(0, 0, w, h)


def intersect(a: Column, b: Column) -> Column:
    """Null where nothing is shared."""
    l, t = F.greatest(a["left"], b["left"]), F.greatest(a["top"], b["top"])  # noqa: E741
    r, o = F.least(a["right"], b["right"]), F.least(a["bottom"], b["bottom"])
    return F.when((l < r) & (t < o), region(l, t, r, o))


def pixel_count(w: Column, h: Column) -> Column:
    return w.cast("long") * h.cast("long")


def argb_bytes(w: Column, h: Column) -> Column:
    return pixel_count(w, h) * 4


# Rotation


def snap(degrees: Column, threshold=SNAP_DEGREES) -> Column:
    """The nearest quarter turn, if it is within the threshold; half turns round to even."""
    t = f32(threshold)
    near = F.rint((f32(degrees) * f32(1.0) / 90).cast("float")).cast("float") * f32(90)
    snapped = F.when(F.abs(degrees - near) <= t, near).otherwise(degrees)
    return F.when(~finite(degrees), f32(0)).when(~finite(t) | (t <= 0), degrees).otherwise(snapped).cast("float")


def is_snapping(degrees: Column, threshold=SNAP_DEGREES) -> Column:
    return finite(degrees) & (snap(degrees, threshold) != degrees)


def normalize(degrees: Column) -> Column:
    wrapped = f32(degrees) % f32(360)
    return F.when(~finite(degrees), f32(0)).when(wrapped < 0, wrapped + f32(360)).otherwise(wrapped).cast("float")


def _trig(fn, degrees: Column) -> Column:
    value = fn((f32(degrees) * f32(RADIANS)).cast("float").cast("double")).cast("float")
    return F.when(F.abs(value) < f32(NEARLY_ZERO), f32(0)).otherwise(value)


def cos_degrees(degrees: Column) -> Column:
    return _trig(F.cos, degrees)


def sin_degrees(degrees: Column) -> Column:
    return _trig(F.sin, degrees)


def turned(p: Column, pivot: Column, cos: Column, sin: Column) -> Column:
    dx, dy = p["x"] - pivot["x"], p["y"] - pivot["y"]
    return point(pivot["x"] + dx * cos - dy * sin, pivot["y"] + dx * sin + dy * cos)


def turned_back(p: Column, pivot: Column, cos: Column, sin: Column) -> Column:
    return turned(p, pivot, cos, -sin)


# View transforms: struct(scale, offset struct(x, y), rotation, flip_h, flip_v)


def transform(scale, offset: Column, rotation, flip_h, flip_v) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(f32(scale).alias("scale"), offset.alias("offset"), f32(rotation).alias("rotation"), lit(flip_h).alias("flip_h"), lit(flip_v).alias("flip_v"))


def is_valid(t: Column) -> Column:
    return finite(t["scale"]) & (t["scale"] > 0) & finite(t["rotation"]) & finite(t["offset"]["x"]) & finite(t["offset"]["y"])


def repaired(t: Column) -> Column:
    return transform(F.when(finite(t["scale"]) & (t["scale"] > 0), t["scale"]).otherwise(f32(1)), sane(t["offset"]), F.when(finite(t["rotation"]), t["rotation"]).otherwise(f32(0)), t["flip_h"], t["flip_v"])


def moved(t: Column, offset: Column) -> Column:
    return transform(t["scale"], offset, t["rotation"], t["flip_h"], t["flip_v"])


def signed_scale(t: Column) -> tuple[Column, Column]:
    return F.when(t["flip_h"], -t["scale"]).otherwise(t["scale"]), F.when(t["flip_v"], -t["scale"]).otherwise(t["scale"])


def map_point(t: Column, p: Column, pivot: Column) -> Column:
    """Scale about the pivot, turn about it, then move."""

    def at(s, q, v):
        kx, ky = signed_scale(s)
        wide = point(v["x"] + (q["x"] - v["x"]) * kx, v["y"] + (q["y"] - v["y"]) * ky)
        return let(wide, lambda m: add(turned(m, v, cos_degrees(s["rotation"]), sin_degrees(s["rotation"])), s["offset"]))

    return let(repaired(t), lambda s: let(sane(p), lambda q: let(sane(pivot), lambda v: at(s, q, v))))


def unmap_point(t: Column, p: Column, pivot: Column) -> Column:
    def at(s, q, v):
        kx, ky = signed_scale(s)
        back = turned_back(subtract(q, s["offset"]), v, cos_degrees(s["rotation"]), sin_degrees(s["rotation"]))
        return let(back, lambda m: point(v["x"] + div(m["x"] - v["x"], kx), v["y"] + div(m["y"] - v["y"], ky)))

    return let(repaired(t), lambda s: let(sane(p), lambda q: let(sane(pivot), lambda v: at(s, q, v))))


def map_corners(t: Column, r: Column, pivot: Column) -> Column:
    return F.transform(corners(r), lambda p: map_point(t, p, pivot))


def map_rect(t: Column, r: Column, pivot: Column) -> Column:
    return let(map_corners(t, r, pivot), bounding)


def scaled_around(t: Column, scale: Column, centroid: Column, pivot: Column) -> Column:
    """A new scale that leaves the centroid where it is."""

    def at(s, ratio):
        rel = subtract(sane(centroid), sane(pivot))
        return transform(scale, add(scaled(rel, f32(1) - ratio), scaled(s["offset"], ratio)), s["rotation"], s["flip_h"], s["flip_v"])

    return let(repaired(t), lambda s: F.when(finite(scale) & (scale > 0), let(div(scale, s["scale"]), lambda ratio: at(s, ratio))).otherwise(s))


# Coordinate spaces: an image of w by h drawn in a content rectangle under a transform


def image_to_viewport(w: Column, h: Column, content: Column, t: Column, p: Column) -> Column:
    local = let(sane(p), lambda q: point(content["left"] + div(q["x"] * width(content), f32(w)), content["top"] + div(q["y"] * height(content), f32(h))))
    return map_point(t, local, center(content))


def viewport_to_image(w: Column, h: Column, content: Column, t: Column, p: Column) -> Column:
    back = unmap_point(t, p, center(content))
    return let(back, lambda q: point(div((q["x"] - content["left"]) * f32(w), width(content)), div((q["y"] - content["top"]) * f32(h), height(content))))


def round_half_up(x: Column) -> Column:
    return F.floor(x.cast("double") + 0.5).cast("int")


def viewport_to_region(w: Column, h: Column, content: Column, t: Column, r: Column) -> Column:
    """The image pixels under a viewport rectangle, or null if none are."""
    box = let(F.transform(corners(r), lambda p: viewport_to_image(w, h, content, t, p)), bounding)
    cut = let(box, lambda b: F.when(is_finite(b), intersect(region(*(round_half_up(b[k]) for k in ("left", "top", "right", "bottom"))), region_of(w, h))))
    return F.when((w > 0) & (h > 0) & usable(content) & usable(r), cut)


def affine(w: Column, h: Column, content: Column, t: Column) -> Column:
    """The 2 by 3 matrix (a, b, c, d, e, f) that takes image points to the viewport: x' = a x + c y + e, y' = b x + d y + f."""
    origin, right, down = (image_to_viewport(w, h, content, t, point(f32(a), f32(b))) for a, b in ((0, 0), (1, 0), (0, 1)))
    return let(F.array(origin, right, down), lambda m: F.array(m[1]["x"] - m[0]["x"], m[1]["y"] - m[0]["y"], m[2]["x"] - m[0]["x"], m[2]["y"] - m[0]["y"], m[0]["x"], m[0]["y"]))


# Coverage


def _unrotated(t: Column, content: Column, cover: Column) -> Column:
    """struct(image, cover): both as boxes, turned back about the content's centre."""
    pivot, cos, sin = center(content), cos_degrees(t["rotation"]), sin_degrees(t["rotation"])
    image = let(F.transform(map_corners(t, content, pivot), lambda p: turned_back(p, pivot, cos, sin)), bounding)
    area = let(F.transform(corners(cover), lambda p: turned_back(p, pivot, cos, sin)), bounding)
    return F.struct(image.alias("image"), area.alias("cover"))


def _axis(lo: Column, hi: Column, cover_lo: Column, cover_hi: Column, bias) -> Column:
    """How far to move [lo, hi] to cover the other; a shorter one is placed by the bias."""
    a, b = cover_hi - hi, cover_lo - lo
    clamped = F.greatest(F.least(f32(0), F.greatest(a, b)), F.least(a, b))
    short = cover_lo + ((cover_hi - cover_lo) - (hi - lo)) * F.greatest(f32(0), F.least(f32(1), f32(bias))) - lo
    return F.when(hi - lo >= cover_hi - cover_lo, clamped).otherwise(short).cast("float")


def coerce_offset(t: Column, content: Column, cover: Column, bias: tuple[float, float] = (0.5, 0.5)) -> Column:
    """The offset that keeps the image over the region, or aligned in it where it is too small."""

    def at(s):
        def move(f):
            i, c = f["image"], f["cover"]
            by = point(_axis(i["left"], i["right"], c["left"], c["right"], bias[0]), _axis(i["top"], i["bottom"], c["top"], c["bottom"], bias[1]))
            return let(by, lambda p: add(s["offset"], turned(p, point(f32(0), f32(0)), cos_degrees(s["rotation"]), sin_degrees(s["rotation"]))))

        return F.when(usable(content) & usable(cover), let(_unrotated(s, content, cover), move)).otherwise(s["offset"])

    return let(repaired(t), at)


def covers(t: Column, content: Column, cover: Column, tolerance: float = 0.0) -> Column:
    """An unusable region is covered by anything; unusable content covers nothing else."""
    give = max(0.0, tolerance)
    inside = let(repaired(t), lambda s: let(_unrotated(s, content, cover), lambda f: contains(inflate(f["image"], give), f["cover"])))
    return F.when(~usable(cover), True).when(~usable(content), False).otherwise(inside)


def correct_coverage(t: Column, content: Column, cover: Column) -> Column:
    """struct(transform, translated, scaled): as it is if that covers, else moved, else grown and placed."""
    target = inflate(cover, SLACK)
    answer = lambda x, a, b: F.struct(x.alias("transform"), a.alias("translated"), b.alias("scaled"))
    no, yes = F.lit(False), F.lit(True)

    def grow(s, shifted):
        def place(f):
            k = F.greatest(div(width(f["cover"]), width(f["image"])), div(height(f["cover"]), height(f["image"])))

            def done(g):
                offset = coerce_offset(g, content, target)
                return let(offset, lambda o: answer(moved(g, o), ~((o["x"] == s["offset"]["x"]) & (o["y"] == s["offset"]["y"])), g["scale"] != s["scale"]))

            grown = let(k, lambda d: transform(s["scale"] * F.greatest(d, f32(1)), s["offset"], s["rotation"], s["flip_h"], s["flip_v"]))
            return F.when(~usable(f["image"]), answer(s, no, no)).when(~finite(k), answer(shifted, yes, no)).otherwise(let(grown, done))

        return let(_unrotated(s, content, target), place)

    def at(s):
        shifted = moved(s, coerce_offset(s, content, target))
        rest = let(shifted, lambda m: F.when(covers(m, content, cover), answer(m, yes, no)).otherwise(grow(s, m)))
        return F.when(~usable(content) | ~usable(cover), answer(s, no, no)).when(covers(s, content, cover), answer(s, no, no)).otherwise(rest)

    return let(repaired(t), at)


def least_covering_scale(t: Column, content: Column, cover: Column, low: float = 1.0, high: float = 4.0, steps: int = 20) -> Column:
    """By bisection in [low, high]."""

    def halve(s, _):
        mid = ((s["lo"] + s["hi"]) * f32(0.5)).cast("float")
        return let(mid, lambda m: let(covers(transform(m, t["offset"], t["rotation"], t["flip_h"], t["flip_v"]), content, cover), lambda ok: F.struct(F.when(ok, s["lo"]).otherwise(m).alias("lo"), F.when(ok, m).otherwise(s["hi"]).alias("hi"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(f32(low).alias("lo"), f32(high).alias("hi")), halve, lambda s: s["hi"])


def frame_bounds(t: Column, content: Column, steps: int = 20) -> Column:
    """The largest box, of the drawn image's proportions and centre, that the turned image covers."""

    def sized(d, k):
        return from_center(center(d), width(d) * k, height(d) * k)

    def search(d):
        def halve(s, _):
            mid = ((s["lo"] + s["hi"]) * f32(0.5)).cast("float")
            return let(mid, lambda m: let(covers(t, content, sized(d, m)), lambda ok: F.struct(F.when(ok, m).otherwise(s["lo"]).alias("lo"), F.when(ok, s["hi"]).otherwise(m).alias("hi"))))

        found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(f32(0).alias("lo"), f32(1).alias("hi")), halve, lambda s: s["lo"])
        return F.when(covers(t, content, d), d).otherwise(let(found, lambda k: sized(d, k)))

    return let(map_rect(t, content, center(content)), search)


def baked(t: Column) -> Column:
    """Whether pixels must be resampled, not only cut out."""
    return (t["rotation"] != 0) | t["flip_h"] | t["flip_v"]


def describe(r: Column, w: Column, h: Column) -> Column:
    """A frame's share of the viewport in words."""
    pct = lambda a, b: round_half_up(div(a, b) * f32(100)).cast("string")
    return F.concat(pct(width(r), w), F.lit("% wide and "), pct(height(r), h), F.lit("% tall"))
