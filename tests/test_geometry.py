"""View geometry: closed forms, inverses, and a sweep checked by un-mapping corners rather than by the same predicate."""

import math
import random

from pyspark.sql import functions as F

from pixelmill.functions import budget as B
from pixelmill.functions import geometry as G
from pixelmill.functions import interaction as I
from pixelmill.functions import recipe as R

col, lit = F.col, F.lit


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_edges(spark):
    nan, inf = lit(float("nan")), lit(float("inf"))
    got = one(
        spark,
        empty=G.is_empty(G.rect(0, 0, nan, 5)), usable=G.usable(G.rect(0, 0, inf, 5)), zero=G.fit_inside(lit(0), lit(5), G.rect(0, 0, 10, 20)),
        snap=G.snap(lit(45.0)), snapped=G.snap(lit(86.0)), none=G.snap(nan), wrap=G.normalize(lit(-90.0)), turn=I.quarter_turn(G.transform(1.0, G.point(lit(0), lit(0)), 350.0 - 90, False, False)),
        cover=G.covers(G.transform(1.0, G.point(lit(0), lit(0)), 0.0, False, False), G.rect(0, 0, 10, 10), G.rect(0, 0, nan, 1)),
        bare=G.covers(G.transform(1.0, G.point(lit(0), lit(0)), 0.0, False, False), G.rect(0, 0, 0, 0), G.rect(0, 0, 1, 1)),
        sane=G.repaired(G.transform(nan, G.point(inf, lit(2)), nan, True, False)),
    )
    assert got.empty and not got.usable and tuple(got.zero) == (5, 10, 5, 10)
    assert got.snap == 45 and got.snapped == 90 and got.none == 0 and got.wrap == 270
    assert got.cover and not got.bare and tuple(got.sane)[:3] == (1.0, (0.0, 2.0), 0.0)
    assert got.turn.rotation == 360  # a threshold of half a turn always snaps, and 360 stays


def _views(n, seed):
    r = random.Random(seed)
    for i in range(n):
        w, h = r.uniform(320, 2400), r.uniform(320, 2400)
        k = r.uniform(0.2, 0.95)
        yield (i, r.uniform(120, 6000), r.uniform(120, 6000), w, h, w * (1 - k) / 2, h * (1 - k) / 2, w * (1 + k) / 2, h * (1 + k) / 2, r.uniform(0.2, 5), r.uniform(-900, 900), r.uniform(-900, 900), r.uniform(-180, 180), r.random() < 0.5, r.random() < 0.5)


def _frame(spark, n, seed):
    names = "i int, iw float, ih float, vw float, vh float, l float, t float, r float, b float, k float, x float, y float, a float, fh boolean, fv boolean"
    df = spark.createDataFrame(list(_views(n, seed)), names)
    view = G.transform(col("k"), G.point(col("x"), col("y")), col("a"), col("fh"), col("fv"))
    return df.select("i", G.fit_inside(col("iw"), col("ih"), G.rect(0, 0, col("vw"), col("vh"))).alias("c"), G.rect(col("l"), col("t"), col("r"), col("b")).alias("f"), view.alias("v"))


def test_corrected_frames_are_covered(spark):
    df = _frame(spark, 400, 1)
    rows = df.select("c", "f", G.covers(col("v"), col("c"), col("f")).alias("was"), G.correct_coverage(col("v"), col("c"), col("f")).alias("x")).collect()
    moved = grown = 0
    for r in rows:
        t, c, f = r.x.transform, r.c, r.f
        moved, grown = moved + r.x.translated, grown + r.x.scaled
        assert r.was == (not r.x.translated and not r.x.scaled)
        px, py, cos, sin = (c.left + c.right) / 2, (c.top + c.bottom) / 2, math.cos(math.radians(t.rotation)), math.sin(math.radians(t.rotation))
        for x, y in ((f.left, f.top), (f.right, f.top), (f.right, f.bottom), (f.left, f.bottom)):
            dx, dy = x - t.offset.x - px, y - t.offset.y - py
            ux, uy = (dx * cos + dy * sin) / t.scale * (-1 if t.flip_h else 1), (dy * cos - dx * sin) / t.scale * (-1 if t.flip_v else 1)
            assert abs(ux) <= (c.right - c.left) / 2 + 0.2 and abs(uy) <= (c.bottom - c.top) / 2 + 0.2
    assert moved > 50 and grown > 50


def test_points_go_there_and_back(spark):
    df = _frame(spark, 200, 2)
    p = G.point(lit(13.0), lit(57.0))
    rows = df.select(G.viewport_to_image(lit(640), lit(480), col("c"), col("v"), G.image_to_viewport(lit(640), lit(480), col("c"), col("v"), p)).alias("p")).collect()
    assert all(abs(r.p.x - 13) < 0.5 and abs(r.p.y - 57) < 0.5 for r in rows)


def test_bisections(spark):
    df = _frame(spark, 40, 3).select(G.frame_bounds(col("v"), col("c")).alias("f"), "v", "c")
    rows = df.select(G.covers(col("v"), col("c"), col("f"), 0.01).alias("ok"), G.usable(col("f")).alias("u")).collect()
    assert all(r.ok for r in rows if r.u)
    least = G.least_covering_scale(G.transform(1.0, G.point(lit(0), lit(0)), 0.0, False, False), G.rect(0, 0, 100, 100), G.rect(-50, -50, 150, 150))
    assert abs(one(spark, s=least).s - 2) < 1e-4


def test_locked_resizes_differ(spark):
    args = (G.rect(0, 0, 100, 100), lit("BottomRight"), G.point(lit(-20), lit(30)), G.rect(0, 0, 400, 400), lit(10.0), lit(1.0))
    got = one(spark, drag=I.resize_drag(*args), nudge=I.resize_nudge(*args), bad=I.resize_drag(*args[:4], lit(500.0), lit(1.0)), act=I.act(lit("move_right"), G.rect(0, 0, 10, 10), G.rect(0, 0, 100, 100), lit(1.0), lit(None).cast("float")))
    assert tuple(got.drag) == (0, 0, 130, 130)  # the larger of both axes
    assert tuple(got.nudge) == (0, 0, 80, 80)  # width alone
    assert tuple(got.bad) == (0, 0, 100, 100) and tuple(got.act) == (8, 0, 18, 10)


def test_recipes(spark):
    good = "recipe1:2.0:1.0:-3.5:90.0:1.0:0.0:0.1:0.2:0.9:0.8:1.5"
    parts = good.split(":")
    bad = [None, "", "recipe2" + good[7:], good + ":1", ":".join(parts[:-1]), good.replace("2.0", "x", 1), good.replace("0.1:", "0.95:", 1), good.replace("0.9", "NaN"), good.replace("1.5", " 1.5")]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([good, good.replace("2.0", "-1", 1), *bad])], "i int, x string").withColumn("r", R.decode(col("x")))
    rows = rows.withColumn("again", F.when(col("r").isNotNull(), R.encode(col("r.transform"), col("r.rect"), col("r.ratio"))))
    got = {r.i: r for r in rows.collect()}
    assert got[0].again == good and got[1].r.transform.scale == 1.0
    assert all(got[i].r is None for i in range(2, 2 + len(bad)))


def test_plans_cover_without_waste(spark):
    df = spark.createDataFrame([(i, i * 137, i * 91, i * 137 + 700 + i * 13, i * 91 + 2000, 1 << (i % 3)) for i in range(30)], "k int, l int, t int, r int, b int, s int")
    plan = B.tile_plan(df, ["k"], G.region(col("l"), col("t"), col("r"), col("b")), col("s"), 10_000).join(df, "k").collect()
    seen = {}
    for p in plan:
        span = 512 * p.s
        assert p["column"] * span < p.r and (p["column"] + 1) * span > p.l and p.row * span < p.b and (p.row + 1) * span > p.t
        seen.setdefault(p.k, set()).add((p["column"], p.row))
    for r in df.collect():
        span = 512 * r.s
        assert len(seen[r.k]) == ((r.r - 1) // span - r.l // span + 1) * ((r.b - 1) // span - r.t // span + 1)


def test_sample_sizes_like_the_loop(spark):
    r = random.Random(5)
    rows = [(i, r.choice([0, 1, r.randrange(1, 40000)]), r.randrange(1, 40000), r.randrange(0, 3000), r.randrange(0, 3000)) for i in range(500)]

    def loop(w, h, tw, th):
        s = 1
        if w <= 0 or h <= 0:
            return 1
        while tw > 0 and th > 0 and s < 65536 and w // (2 * s) >= tw and h // (2 * s) >= th:
            s *= 2
        while s < 65536 and not (4 * max(w // s, 1) * max(h // s, 1) <= B.DISPLAY[0] and max(w // s, 1) <= 4096 and max(h // s, 1) <= 4096):
            s *= 2
        return s

    df = spark.createDataFrame(rows, "i int, w int, h int, tw int, th int")
    got = {x.i: x.s for x in df.select("i", B.sample_size(col("w"), col("h"), col("tw"), col("th")).alias("s")).collect()}
    assert got == {i: loop(*x) for i, *x in rows}
