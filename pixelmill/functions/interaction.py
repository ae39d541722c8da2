"""Frame editing: hit tests, two resize rules, aspect ratios, gesture steps. Handles are strings such as TopLeft or Inside."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelmill.functions import geometry as G
from pixelmill.functions.binary import let
from pixelmill.functions.geometry import div, f32, finite, rect

#: Handles in the order in which ties are decided.
CORNERS, EDGES = ("TopLeft", "TopRight", "BottomLeft", "BottomRight"), ("Left", "Right", "Top", "Bottom")


def moves_left(h: Column) -> Column:
    return h.isin("TopLeft", "BottomLeft", "Left", "Inside")


def moves_right(h: Column) -> Column:
    return h.isin("TopRight", "BottomRight", "Right", "Inside")


def moves_top(h: Column) -> Column:
    return h.isin("TopLeft", "TopRight", "Top", "Inside")


def moves_bottom(h: Column) -> Column:
    return h.isin("BottomLeft", "BottomRight", "Bottom", "Inside")


def hit_test(r: Column, p: Column, radius: Column) -> Column:
    """The nearest corner within the radius, else the nearest edge, else Inside, else null."""
    reach = F.when(finite(radius) & (radius > 0), f32(radius)).otherwise(f32(0))

    def nearest(found: Column) -> Column:
        return F.array_min(found)

    def corner(k: int, name: str) -> Column:
        dx = p["x"] - r["left" if "Left" in name else "right"]
        dy = p["y"] - r["top" if "Top" in name else "bottom"]
        return F.struct((dx * dx + dy * dy).alias("d"), F.lit(k).alias("k"), F.lit(name).alias("name"))

    def edge(k: int, name: str) -> Column:
        upright = name in ("Left", "Right")
        along, lo, hi = (p["y"], r["top"], r["bottom"]) if upright else (p["x"], r["left"], r["right"])
        d = F.abs((p["x"] if upright else p["y"]) - r[name.lower()])
        return F.when((along >= lo - reach) & (along <= hi + reach) & (d <= reach), F.struct(d.alias("d"), F.lit(k).alias("k"), F.lit(name).alias("name")))

    by_corner = let(nearest(F.array(*(corner(k, n) for k, n in enumerate(CORNERS)))), lambda x: F.when(x["d"] <= reach * reach, x["name"]))
    by_edge = let(nearest(F.array(*(edge(k, n) for k, n in enumerate(EDGES)))), lambda x: x["name"])
    found = F.coalesce(by_corner, by_edge, F.when(G.contains_point(r, p), "Inside"))
    return F.when(G.usable(r) & finite(p["x"]) & finite(p["y"]), found)


def _clamp(x: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest(x, lo), hi)


def resize_drag(origin: Column, handle: Column, delta: Column, bounds: Column, minimum: Column, ratio: Column) -> Column:
    """The frame after a drag from `origin`; ratio null: free. An impossible locked range returns the origin."""
    least_side = F.when(finite(minimum) & (minimum > 0), f32(minimum)).otherwise(f32(0))

    def step(o, b, d, m):
        span = lambda x, lo, hi: _clamp(x, F.least(lo, hi), F.greatest(lo, hi))
        by = G.point(span(d["x"], b["left"] - o["left"], b["right"] - o["right"]), span(d["y"], b["top"] - o["top"], b["bottom"] - o["bottom"]))
        carried = let(by, lambda q: G.translate(o, q))
        free = rect(
            F.when(moves_left(handle), F.least(F.greatest(o["left"] + d["x"], b["left"]), o["right"] - m)).otherwise(o["left"]),
            F.when(moves_top(handle), F.least(F.greatest(o["top"] + d["y"], b["top"]), o["bottom"] - m)).otherwise(o["top"]),
            F.when(moves_right(handle), F.greatest(F.least(o["right"] + d["x"], b["right"]), o["left"] + m)).otherwise(o["right"]),
            F.when(moves_bottom(handle), F.greatest(F.least(o["bottom"] + d["y"], b["bottom"]), o["top"] + m)).otherwise(o["bottom"]),
        )
        zero, c = f32(0), G.center(o)
        wide = G.width(o) + F.when(moves_right(handle), d["x"]).otherwise(zero) - F.when(moves_left(handle), d["x"]).otherwise(zero)
        high = G.height(o) + F.when(moves_bottom(handle), d["y"]).otherwise(zero) - F.when(moves_top(handle), d["y"]).otherwise(zero)
        wide, high = _clamp(wide, m, G.width(b)), _clamp(high, m, G.height(b)) * f32(ratio)
        driven = F.when(handle.isin(*CORNERS), F.greatest(wide, high)).when(handle.isin("Top", "Bottom"), high).otherwise(wide)
        room_x = F.when(moves_left(handle), o["right"] - b["left"]).when(moves_right(handle), b["right"] - o["left"]).otherwise(f32(2) * F.least(c["x"] - b["left"], b["right"] - c["x"]))
        room_y = F.when(moves_top(handle), o["bottom"] - b["top"]).when(moves_bottom(handle), b["bottom"] - o["top"]).otherwise(f32(2) * F.least(c["y"] - b["top"], b["bottom"] - c["y"]))
        most = F.least(G.width(b), G.height(b) * f32(ratio), room_x, room_y * f32(ratio))
        locked = let(F.greatest(F.least(driven, most), m, m * f32(ratio)), lambda w: _placed(o, handle, w, ratio))
        bad = (m > G.width(b)) | (m > G.height(b))
        return F.when(handle == "Inside", carried).when(ratio.isNull(), free).when(bad, o).otherwise(locked)

    done = let(G.sane(delta), lambda d: let(least_side, lambda m: step(origin, bounds, d, m)))
    return F.when(G.usable(origin) & G.usable(bounds), done).otherwise(origin)


def _placed(o: Column, handle: Column, w: Column, ratio: Column) -> Column:
    """A frame of width w whose unmoved sides stay; an axis without a moved side keeps its centre."""
    h, c = div(w, ratio), G.center(o)
    left = F.when(moves_left(handle), o["right"] - w).when(moves_right(handle), o["left"]).otherwise(c["x"] - w * f32(0.5))
    top = F.when(moves_top(handle), o["bottom"] - h).when(moves_bottom(handle), o["top"]).otherwise(c["y"] - h * f32(0.5))
    return let(F.struct(left.alias("l"), top.alias("t"), h.alias("h")), lambda x: rect(x["l"], x["t"], x["l"] + w, x["t"] + x["h"]))


def nudged_inside(r: Column, bounds: Column) -> Column:
    """Moved, not resized, into the bounds; a frame that is too large is aligned at the start."""

    def shift(size, room, lo, hi, b_lo, b_hi):
        return F.when(size >= room, b_lo - lo).when(lo < b_lo, b_lo - lo).when(hi > b_hi, b_hi - hi).otherwise(f32(0))

    dx = shift(G.width(r), G.width(bounds), r["left"], r["right"], bounds["left"], bounds["right"])
    dy = shift(G.height(r), G.height(bounds), r["top"], r["bottom"], bounds["top"], bounds["bottom"])
    return G.translate(r, G.point(dx, dy))


def resize_nudge(current: Column, handle: Column, delta: Column, bounds: Column, minimum: Column, ratio: Column) -> Column:
    """The keyboard's rule: with a ratio, any handle that moves a side edge is driven by width alone."""

    def clamp(x, lo, hi):
        return F.when(lo > hi, lo).otherwise(_clamp(x, lo, hi))

    def step(r, d, m):
        free = rect(
            F.when(moves_left(handle), clamp(r["left"] + d["x"], bounds["left"], r["right"] - m)).otherwise(r["left"]),
            F.when(moves_top(handle), clamp(r["top"] + d["y"], bounds["top"], r["bottom"] - m)).otherwise(r["top"]),
            F.when(moves_right(handle), clamp(r["right"] + d["x"], r["left"] + m, bounds["right"])).otherwise(r["right"]),
            F.when(moves_bottom(handle), clamp(r["bottom"] + d["y"], r["top"] + m, bounds["bottom"])).otherwise(r["bottom"]),
        )
        wide = F.when(moves_left(handle), G.width(r) - d["x"]).otherwise(G.width(r) + d["x"])
        high = F.when(moves_top(handle), G.height(r) - d["y"]).otherwise(G.height(r) + d["y"]) * f32(ratio)
        target = F.when(moves_left(handle) | moves_right(handle), wide).otherwise(high)
        lo, hi = F.greatest(m, m * f32(ratio)), F.least(G.width(bounds), G.height(bounds) * f32(ratio))
        locked = let(F.when(lo > hi, hi).otherwise(_clamp(target, lo, hi)), lambda w: let(_placed(r, handle, w, ratio), lambda x: nudged_inside(x, bounds)))
        carried = let(G.translate(r, d), lambda x: nudged_inside(x, bounds))
        return F.when(handle == "Inside", carried).when(ratio.isNull(), free).otherwise(locked)

    m = _clamp(f32(minimum), f32(0), F.least(G.width(bounds), G.height(bounds)))
    done = let(G.sane(delta), lambda d: let(m, lambda x: step(current, d, x)))
    return F.when(G.is_empty(bounds) | ~G.usable(current), current).otherwise(done)


def conform(r: Column, ratio: Column, viewport: Column) -> Column:
    """The frame at a ratio: same area and centre, shrunk to fit, kept inside."""
    area = G.width(r) * G.height(r)
    w = F.sqrt((area * f32(ratio)).cast("double")).cast("float")

    def fitted(x):
        h = div(x, ratio)
        k = F.least(f32(1), div(G.width(viewport), x), div(G.height(viewport), h))
        return let(k, lambda s: let(G.from_center(G.center(r), x * s, h * s), lambda q: nudged_inside(q, viewport)))

    return F.when(ratio.isNull() | ~G.usable(r) | G.is_empty(viewport), r).otherwise(let(w, lambda x: F.when(finite(x) & (x > 0), fitted(x)).otherwise(r)))


def opening_frame(content: Column, inset: float = 0.1) -> Column:
    dx, dy = G.width(content) * f32(inset), G.height(content) * f32(inset)
    return rect(content["left"] + dx, content["top"] + dy, content["right"] - dx, content["bottom"] - dy)


def to_fractions(r: Column, w: Column, h: Column) -> Column:
    return rect(div(r["left"], w), div(r["top"], h), div(r["right"], w), div(r["bottom"], h))


def to_pixels(r: Column, w: Column, h: Column) -> Column:
    return rect(r["left"] * f32(w), r["top"] * f32(h), r["right"] * f32(w), r["bottom"] * f32(h))


def pinch(t: Column, zoom: Column, turn: Column, pan: Column, centroid: Column, pivot: Column, lo: float = 1.0, hi: float = 10.0) -> Column:
    """One step of a two-finger gesture: scale about the fingers, follow them, turn and snap."""
    scale = F.least(F.greatest(t["scale"] * f32(zoom), f32(lo)), f32(hi))
    about = G.scaled_around(t, scale, centroid, pivot)
    return let(about, lambda s: G.transform(s["scale"], G.add(s["offset"], pan), G.snap((s["rotation"] + f32(turn)).cast("float")), s["flip_h"], s["flip_v"]))


def fling_speed(v: Column, least: float = 60.0, most: float = 8000.0) -> Column:
    """A velocity worth a fling, its length limited; else null."""
    length = F.sqrt((v["x"] * v["x"] + v["y"] * v["y"]).cast("double")).cast("float")
    return F.when(finite(v["x"]) & finite(v["y"]) & (length >= f32(least)), let(F.least(f32(1), div(f32(most), length)), lambda k: G.scaled(v, k)))


def quarter_turn(t: Column, by: float = 90.0) -> Column:
    return G.transform(t["scale"], t["offset"], G.snap((t["rotation"] + f32(by)).cast("float"), 180.0), t["flip_h"], t["flip_v"])


def flipped(t: Column, horizontal: bool = True) -> Column:
    h, v = (~t["flip_h"], t["flip_v"]) if horizontal else (t["flip_h"], ~t["flip_v"])
    return G.transform(t["scale"], t["offset"], t["rotation"], h, v)


#: Keyboard and assistive actions -> (handle, x, y) of a nudge, in steps.
ACTIONS = {
    "move_left": ("Inside", -1, 0), "move_right": ("Inside", 1, 0), "move_up": ("Inside", 0, -1), "move_down": ("Inside", 0, 1),
    "widen_right": ("Right", 1, 0), "narrow_right": ("Right", -1, 0), "widen_left": ("Left", -1, 0), "narrow_left": ("Left", 1, 0),
    "taller_bottom": ("Bottom", 0, 1), "shorter_bottom": ("Bottom", 0, -1), "taller_top": ("Top", 0, -1), "shorter_top": ("Top", 0, 1),
}


def act(action: Column, r: Column, bounds: Column, minimum: Column, ratio: Column, step: float = 8.0) -> Column:
    """The frame after a named action; an unknown one changes nothing."""
    pick = lambda k: F.create_map(*(F.lit(x) for name, a in ACTIONS.items() for x in (name, a[k])))[action]
    move = G.point(pick(1).cast("float") * f32(step), pick(2).cast("float") * f32(step))
    return F.when(action.isin(*ACTIONS), resize_nudge(r, pick(0), move, bounds, minimum, ratio)).otherwise(r)
