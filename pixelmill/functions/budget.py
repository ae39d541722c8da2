"""Decode budgets, sample sizes and tile plans: integer arithmetic, native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.functions import geometry as G
from pixelmill.functions.binary import let

#: Fixed values: (bytes, longest side) of each budget; the largest sample size is 2**16.
DISPLAY, OUTPUT, MOST_LOG = (64 << 20, 4096), (192 << 20, 32766), 16
TILE = 512


def sampled(x: Column, sample: Column) -> Column:
    return F.greatest(F.floor(x / sample).cast("int"), F.lit(1))


def admits(w: Column, h: Column, budget: tuple[int, int]) -> Column:
    return (G.argb_bytes(w, h) <= budget[0]) & (w <= budget[1]) & (h <= budget[1])


def half(budget: tuple[int, int]) -> tuple[int, int]:
    """For a crop whose source and result exist at once."""
    return budget[0] // 2, budget[1]


def sample_size(w: Column, h: Column, target_w: Column, target_h: Column, budget: tuple[int, int] = DISPLAY) -> Column:
    """The largest power of two that still fills the target, or the least one from there on that the budget admits.

    Both conditions are monotone in the exponent, so each is an extreme over 0..16.
    """
    powers = F.array(*(F.lit(1 << k) for k in range(MOST_LOG + 1)))
    fills = lambda s: (s == 1) | ((target_w > 0) & (target_h > 0) & (F.floor(w / s) >= target_w) & (F.floor(h / s) >= target_h))
    start = F.array_max(F.filter(powers, fills))
    ok = lambda a: F.array_min(F.filter(powers, lambda s: (s >= a) & ((s == 1 << MOST_LOG) | admits(sampled(w, s), sampled(h, s), budget))))
    return F.when((w <= 0) | (h <= 0), 1).otherwise(let(start, ok)).cast("int")


def power_of_two_at_most(x: Column) -> Column:
    powers = F.array(*(F.lit(1 << k) for k in range(31)))
    return F.coalesce(F.array_max(F.filter(powers, lambda p: p <= x)), F.lit(1)).cast("int")


def max_tiles(budget_bytes: Column) -> Column:
    return F.least(F.greatest(F.floor(budget_bytes / (4 * TILE * TILE)), F.lit(1)), F.lit(2147483647)).cast("int")


def tile_region(sample: Column, column: Column, row: Column, w: Column, h: Column) -> Column:
    """A tile's pixels, cut at the image's edge; null outside."""
    span = sample.cast("long") * TILE
    most = lambda x, size: F.least(x, size.cast("long"))
    raw = G.region(column * span, row * span, most((column + 1) * span, w), most((row + 1) * span, h))
    return G.intersect(raw, G.region_of(w, h))


def tile_plan(df: DataFrame, key: list[str], region: Column, sample: Column, most: int | Column) -> DataFrame:
    """A row for each tile wanted: key, sample_size, column, row, rank; nearest the region's centre first, up to `most`.

    Tiles are generated for each row and ranked within it, without a shuffle: a sorted, truncated array per row.
    """
    limit = most if isinstance(most, Column) else F.lit(most)
    span = (F.col("_s").cast("long") * TILE).cast("int")
    r = F.col("_r")
    cells = lambda lo, hi: F.sequence(F.floor(r[lo] / span).cast("int"), F.floor((r[hi] - 1) / span).cast("int"))
    cx, cy = (r["left"] + r["right"]).cast("float") * G.f32(0.5), (r["top"] + r["bottom"]).cast("float") * G.f32(0.5)

    def cell(row):
        def one(column):
            dx = (column * span).cast("float") + span.cast("float") * G.f32(0.5) - cx
            dy = (row * span).cast("float") + span.cast("float") * G.f32(0.5) - cy
            return F.struct((dx * dx + dy * dy).alias("d"), row.alias("row"), column.alias("column"))

        return F.transform(cells("left", "right"), one)

    tiles = F.slice(F.sort_array(F.flatten(F.transform(cells("top", "bottom"), cell))), F.lit(1), F.greatest(limit, F.lit(0)))
    out = df.select(*key, region.alias("_r"), sample.alias("_s")).filter("_r is not null")
    out = out.select(*key, F.col("_s").alias("sample_size"), F.posexplode(tiles).alias("rank", "t"))
    return out.select(*key, "sample_size", F.col("t.column").alias("column"), F.col("t.row").alias("row"), F.col("rank"))


def tile_requests(wanted: DataFrame, in_flight: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(to start, to cancel): what is wanted but not in flight, and the other way round."""
    return wanted.join(in_flight, key, "left_anti"), in_flight.join(wanted, key, "left_anti")


def ranked(df: DataFrame, group: list[str], order: list, most: int) -> DataFrame:
    """The first `most` rows of each group."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_k") <= most).drop("_k")
