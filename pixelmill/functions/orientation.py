"""Declared orientation 1 to 8: a clockwise turn, then a mirror in the turned frame. All native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Orientation -> (clockwise degrees, mirrored).
TURNS = {1: (0, False), 2: (0, True), 3: (180, False), 4: (180, True), 5: (90, True), 6: (90, False), 7: (270, True), 8: (270, False)}


def from_exif(value: Column) -> Column:
    """Anything unreadable is upright, never null."""
    return F.when(value.between(1, 8), value).otherwise(1).cast("int")


def rotation_degrees(o: Column) -> Column:
    return F.when(o.isin(5, 6), 90).when(o.isin(3, 4), 180).when(o.isin(7, 8), 270).otherwise(0)


def is_mirrored(o: Column) -> Column:
    return o.isin(2, 4, 5, 7)


def transposes(o: Column) -> Column:
    return o.isin(5, 6, 7, 8)


def oriented_size(o: Column, w: Column, h: Column) -> Column:
    return F.struct(F.when(transposes(o), h).otherwise(w).alias("width"), F.when(transposes(o), w).otherwise(h).alias("height"))


def inverse(o: Column) -> Column:
    """Only the plain quarter turns are not their own inverse."""
    return F.when(o == 6, 8).when(o == 8, 6).otherwise(o).cast("int")


def map_region(o: Column, r: Column, w: Column, h: Column) -> Column:
    """A half-open rectangle of an image of w by h, in the oriented image."""
    turn = rotation_degrees(o)
    left = F.when(turn == 90, h - r["bottom"]).when(turn == 180, w - r["right"]).when(turn == 270, r["top"]).otherwise(r["left"])
    right = F.when(turn == 90, h - r["top"]).when(turn == 180, w - r["left"]).when(turn == 270, r["bottom"]).otherwise(r["right"])
    top = F.when(turn == 90, r["left"]).when(turn == 180, h - r["bottom"]).when(turn == 270, w - r["right"]).otherwise(r["top"])
    bottom = F.when(turn == 90, r["right"]).when(turn == 180, h - r["top"]).when(turn == 270, w - r["left"]).otherwise(r["bottom"])
    wide = F.when(transposes(o), h).otherwise(w)
    flip = is_mirrored(o)
    return F.struct(F.when(flip, wide - right).otherwise(left).alias("left"), top.alias("top"), F.when(flip, wide - left).otherwise(right).alias("right"), bottom.alias("bottom"))


def to_oriented(o: Column, r: Column, w: Column, h: Column) -> Column:
    return map_region(o, r, w, h)


def to_raw(o: Column, r: Column, w: Column, h: Column) -> Column:
    """w, h: the raw image's size."""
    return map_region(inverse(o), r, F.when(transposes(o), h).otherwise(w), F.when(transposes(o), w).otherwise(h))


def outstanding(o: Column, applied_by_decoder: Column) -> Column:
    return F.when(applied_by_decoder, 1).otherwise(o).cast("int")
