"""A crop as text: a prefix and eleven floats between colons, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelmill.functions import geometry as G
from pixelmill.functions.binary import let
from pixelmill.functions.geometry import f32, finite

PREFIX = "recipe1"
#: What counts as a number: signs, decimals, exponents, and the three words.
NUMBER = r"^[+-]?(?:NaN|Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?[fFdD]?)$"


def encode(t: Column, r: Column, ratio: Column, prefix: str = PREFIX) -> Column:
    flag = lambda x: F.when(x, f32(1)).otherwise(f32(0))
    values = [t["scale"], t["offset"]["x"], t["offset"]["y"], t["rotation"], flag(t["flip_h"]), flag(t["flip_v"]), r["left"], r["top"], r["right"], r["bottom"], F.coalesce(f32(ratio), f32(-1))]
    return F.concat_ws(":", F.lit(prefix), *(f32(v).cast("string") for v in values))


def decode(text: Column, prefix: str = PREFIX) -> Column:
    """struct(transform, rect, ratio); null for a wrong prefix, count, number or rectangle. A bad transform is repaired."""
    parts = F.split(text, ":", -1)

    def number(x):
        return F.when(x.rlike(NUMBER), F.regexp_replace(x, "[fFdD]$", "").try_cast("float"))

    def build(v):
        r = G.rect(v[6], v[7], v[8], v[9])
        t = G.repaired(G.transform(v[0], G.point(v[1], v[2]), v[3], v[4] != 0, v[5] != 0))
        ratio = F.when(finite(v[10]) & (v[10] > 0), v[10])
        return F.when(G.usable(r), F.struct(t.alias("transform"), r.alias("rect"), ratio.alias("ratio")))

    values = F.transform(F.slice(parts, 2, 11), number)
    ok = (F.size(parts) == 12) & (F.element_at(parts, 1) == prefix)
    return F.when(ok, let(values, lambda v: F.when(F.forall(v, lambda x: x.isNotNull()), build(v))))


def cache_key(base: Column, region: Column) -> Column:
    return F.concat(base, F.lit("crop:"), F.concat_ws(",", *(region[k].cast("string") for k in ("left", "top", "right", "bottom"))))
