"""Queries over the driver's tables. No table holds images: sizes, rectangles and header bytes are derived from keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.functions import budget as B
from pixelmill.functions import geometry as G
from pixelmill.functions import headers as H
from pixelmill.functions import interaction as I
from pixelmill.functions import orientation as O
from pixelmill.functions import recipe as R
from pixelmill.operators import cache, exif
from pixelmill.session import ship, table
from pixelmill.streaming import gestures

col, lit = F.col, F.lit
_ALL, _SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        _ALL[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


POWERS = "[" + ", ".join(str(1 << k) for k in range(17)) + "]"
SAMPLE_SQL = f"""list_min(list_filter({POWERS}, lambda s: s >= {{a}} AND (s = 65536 OR (greatest({{w}} // s, 1) * greatest({{h}} // s, 1) * 4 <= 67108864
  AND greatest({{w}} // s, 1) <= 4096 AND greatest({{h}} // s, 1) <= 4096))))"""
START_SQL = f"list_max(list_filter({POWERS}, lambda s: s = 1 OR ({{w}} // s >= {{tw}} AND {{h}} // s >= {{th}})))"


def _part(spark, d):
    return table(spark, d, "part").select("p_partkey", (col("p_size") * 311).alias("w"), ((col("p_partkey") % 997 + 1) * 13).cast("int").alias("h"))


@query(f"""SELECT 'PNG' AS format, ({SAMPLE_SQL.format(a=1, w='w', h='h')})::INTEGER AS sample_size, count(*) AS n
FROM (SELECT p_size * 311 AS w, (p_partkey % 997 + 1) * 13 AS h FROM part) GROUP BY ALL""")
def probe_png_sample_size(spark: SparkSession, d: str) -> DataFrame:
    p = _part(spark, d).select(H.probe(H.build_png(col("w"), col("h")), jpeg=False).alias("p"))
    s = B.sample_size(col("p.width"), col("p.height"), lit(0), lit(0))
    return p.select(col("p.format").alias("format"), s.alias("sample_size")).groupBy("format", "sample_size").agg(F.count(lit(1)).alias("n"))


@query(f"""SELECT p_partkey, ({SAMPLE_SQL.format(a=START_SQL.format(w='w', h='h', tw='tw', th='th'), w='w', h='h')})::INTEGER AS sample_size
FROM (SELECT p_partkey, p_size * 311 AS w, (p_partkey % 997 + 1) * 13 AS h, p_size * 7 AS tw, p_partkey % 50 + 1 AS th FROM part)""")
def sample_size_for_target(spark, d):
    t = table(spark, d, "part")
    return t.select("p_partkey", B.sample_size(col("p_size") * 311, ((col("p_partkey") % 997 + 1) * 13).cast("int"), col("p_size") * 7, (col("p_partkey") % 50 + 1).cast("int")).alias("sample_size"))


def _probe_parts(spark, d, build, w, h):
    t = table(spark, d, "part").select("p_partkey", H.probe(build(w, h), jpeg=False).alias("p"))
    return t.select("p_partkey", col("p.format").alias("format"), col("p.width").alias("width"), col("p.height").alias("height"))


W16, H16 = "(p_size * 311)::INTEGER", "(p_partkey % 997 + 1)::INTEGER"


@query(f"SELECT p_partkey, 'GIF' AS format, {W16} AS width, {H16} AS height FROM part")
def probe_gif(spark, d):
    return _probe_parts(spark, d, H.build_gif, col("p_size") * 311, col("p_partkey") % 997 + 1)


@query(f"SELECT p_partkey, 'WEBP' AS format, CASE WHEN ok THEN w END AS width, CASE WHEN ok THEN h END AS height FROM (SELECT *, w > 0 AND h > 0 AS ok FROM (SELECT p_partkey, {W16} & 16383 AS w, {H16} & 16383 AS h FROM part))")
def probe_webp_vp8(spark, d):
    return _probe_parts(spark, d, lambda w, h: H.build_webp("VP8 ", w, h), col("p_size") * 311, col("p_partkey") % 997 + 1)


@query("SELECT p_partkey, 'WEBP' AS format, (p_size * 311)::INTEGER AS width, (p_partkey % 997 + 1)::INTEGER AS height FROM part")
def probe_webp_vp8l(spark, d):
    return _probe_parts(spark, d, lambda w, h: H.build_webp("VP8L", w, h), col("p_size") * 311, col("p_partkey") % 997 + 1)


@query("SELECT p_partkey, 'WEBP' AS format, (p_size * 90001)::INTEGER AS width, (p_partkey % 997 + 70000)::INTEGER AS height FROM part")
def probe_webp_vp8x(spark, d):
    return _probe_parts(spark, d, lambda w, h: H.build_webp("VP8X", w, h), col("p_size") * 90001, col("p_partkey") % 997 + 70000)


BRANDS = ["heic", "mif1", "avif", "isom", "avis", "msf1", "jpg "]


@query("""SELECT s_suppkey, CASE WHEN a IN ('avif', 'avis') OR b IN ('avif', 'avis') THEN 'AVIF' WHEN a IN ('heic', 'mif1', 'msf1') OR b IN ('heic', 'mif1', 'msf1') THEN 'HEIF' END AS format
FROM (SELECT s_suppkey, brands[s_suppkey % 7 + 1] AS a, brands[s_nationkey % 7 + 1] AS b FROM supplier, (SELECT ['heic', 'mif1', 'avif', 'isom', 'avis', 'msf1', 'jpg '] AS brands))""")
def probe_isobmff_brand(spark, d):
    names = F.array(*map(lit, BRANDS))
    pick = lambda k: F.element_at(names, (k % 7 + 1).cast("int"))
    hexed = F.concat(lit("00000014"), lit(b"ftyp".hex()), F.hex(pick(col("s_suppkey"))), lit("00000000"), F.hex(pick(col("s_nationkey"))))
    t = table(spark, d, "supplier").select("s_suppkey", H.probe(F.unhex(hexed), jpeg=False).alias("p"))
    return t.select("s_suppkey", col("p.format").alias("format"))


@query(f"SELECT p_partkey, 'JPEG' AS format, {W16} AS width, {H16} AS height FROM part")
def probe_jpeg(spark, d):
    """An application segment of varying length stands before the frame header."""
    ship(spark)
    n = col("p_partkey") % 40 + 2
    segment = F.concat(lit("FFD8FFE0"), H.hex_be(n, 2), F.repeat(lit("00"), (n - 2).cast("int")))
    frame = F.concat(lit("FFC2001108"), H.hex_be(col("p_partkey") % 997 + 1, 2), H.hex_be(col("p_size") * 311, 2), lit("03"))
    t = table(spark, d, "part").select("p_partkey", H.probe(F.unhex(F.concat(segment, frame))).alias("p"))
    return t.select("p_partkey", col("p.format").alias("format"), col("p.width").alias("width"), col("p.height").alias("height"))


@query("""SELECT l_orderkey, l_linenumber, (CASE WHEN l_linenumber % 3 = 2 THEN [1, 8, 3, 6][l_orderkey % 4 + 1]
  WHEN l_orderkey % 10 BETWEEN 1 AND 8 THEN l_orderkey % 10 ELSE 1 END)::INTEGER AS orientation FROM lineitem""")
def exif_orientation(spark, d):
    """JPEG, WebP and HEIF files from keys. Before the block that counts stand an Exif block without the tag and, in a JPEG, a
    marker that stands alone."""
    ship(spark)
    k, exif_id, none = col("l_orderkey"), b"Exif\0\0".hex(), "49492A0008000000" + "0000" + "00000000"
    tiff = F.concat(lit("49492A000800000001001201030001000000"), H.hex_le(k % 10, 2), lit("000000000000"))
    jpeg = F.concat(lit(f"FFD8FFE10016{exif_id}{none}FFD9FFE10022{exif_id}"), tiff)
    webp = F.concat(lit(f"{b'RIFF'.hex()}00000000{b'WEBPEXIF'.hex()}0E000000{none}{b'EXIF'.hex()}1A000000"), tiff)
    heif = F.concat(lit(f"00000014{b'ftypisom'.hex()}00000000{b'mif1'.hex()}00000025{b'meta'.hex()}0000000000000019{b'iprp'.hex()}00000011{b'ipco'.hex()}00000009{b'irot'.hex()}"), H.hex_be(k % 4, 1))
    which = col("l_linenumber") % 3
    content = F.unhex(F.when(which == 0, jpeg).when(which == 1, webp).otherwise(heif))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", exif.orientation_of(content).alias("orientation"))


def _rects(spark, d):
    t = table(spark, d, "lineitem")
    left, top = (col("l_partkey") % 3000).cast("int"), (col("l_suppkey") % 2000).cast("int")
    r = G.region(left, top, left + 1 + (col("l_orderkey") % 900).cast("int"), top + 1 + col("l_linenumber") * 100)
    return t.select("l_orderkey", "l_linenumber", (col("l_orderkey") % 8 + 1).cast("int").alias("o"), r.alias("r"))


RECTS_SQL = """(SELECT l_orderkey, l_linenumber, l_orderkey % 8 + 1 AS o, l_partkey % 3000 AS l, l_suppkey % 2000 AS t,
  l_partkey % 3000 + 1 + l_orderkey % 900 AS r, l_suppkey % 2000 + 1 + l_linenumber * 100 AS b FROM lineitem)"""


def _flat(t, r):
    return t.select("l_orderkey", "l_linenumber", *(r[k].cast("int").alias(f"x_{k}") for k in ("left", "top", "right", "bottom")))


def _cases(names: dict[int, tuple[str, str, str, str]]) -> str:
    parts = []
    for i, k in enumerate(("left", "top", "right", "bottom")):
        parts.append("(CASE o " + " ".join(f"WHEN {o} THEN {v[i]}" for o, v in names.items()) + f" END)::INTEGER AS x_{k}")
    return ", ".join(parts)


#: An image of 4000 by 3000; where each orientation puts l, t, r, b.
FORWARD = {1: ("l", "t", "r", "b"), 2: ("4000 - r", "t", "4000 - l", "b"), 3: ("4000 - r", "3000 - b", "4000 - l", "3000 - t"), 4: ("l", "3000 - b", "r", "3000 - t"), 5: ("t", "l", "b", "r"), 6: ("3000 - b", "l", "3000 - t", "r"), 7: ("3000 - b", "4000 - r", "3000 - t", "4000 - l"), 8: ("t", "4000 - r", "b", "4000 - l")}
BACKWARD = {1: ("l", "t", "r", "b"), 2: ("4000 - r", "t", "4000 - l", "b"), 3: ("4000 - r", "3000 - b", "4000 - l", "3000 - t"), 4: ("l", "3000 - b", "r", "3000 - t"), 5: ("t", "l", "b", "r"), 6: ("t", "3000 - r", "b", "3000 - l"), 7: ("4000 - b", "3000 - r", "4000 - t", "3000 - l"), 8: ("4000 - b", "l", "4000 - t", "r")}


@query(f"SELECT l_orderkey, l_linenumber, {_cases(FORWARD)} FROM {RECTS_SQL}")
def region_to_oriented(spark, d):
    t = _rects(spark, d)
    return _flat(t, O.to_oriented(col("o"), col("r"), lit(4000), lit(3000)))


@query(f"SELECT l_orderkey, l_linenumber, {_cases(BACKWARD)} FROM {RECTS_SQL}")
def region_to_raw(spark, d):
    t = _rects(spark, d)
    return _flat(t, O.to_raw(col("o"), col("r"), lit(4000), lit(3000)))


@query("SELECT l_orderkey, l_linenumber, (CASE WHEN l_orderkey % 8 + 1 >= 5 THEN 3000 ELSE 4000 END)::INTEGER AS width, (CASE WHEN l_orderkey % 8 + 1 >= 5 THEN 4000 ELSE 3000 END)::INTEGER AS height FROM lineitem")
def oriented_size(spark, d):
    t = _rects(spark, d).select("l_orderkey", "l_linenumber", O.oriented_size(col("o"), lit(4000), lit(3000)).alias("s"))
    return t.select("l_orderkey", "l_linenumber", "s.width", "s.height")


@query(f"SELECT l_orderkey, l_linenumber, l::INTEGER AS x_left, t::INTEGER AS x_top, least(r, 2500)::INTEGER AS x_right, least(b, 1500)::INTEGER AS x_bottom FROM {RECTS_SQL} WHERE l < 2500 AND t < 1500")
def region_intersect(spark, d):
    t = _rects(spark, d).withColumn("x", G.intersect(col("r"), G.region(0, 0, 2500, 1500))).filter("x is not null")
    return _flat(t, col("x"))


ORDERS_SQL = """(SELECT o_orderkey, (o_custkey % 4) AS q, (1 << (o_orderkey % 3)::INTEGER) AS k, (o_orderkey % 33 - 16) * 16 AS ox, (o_custkey % 17 - 8) * 16 AS oy,
  (o_orderkey % 40) * 16 AS fl, (o_custkey % 40) * 16 AS ft, (o_orderkey % 40) * 16 + 128 AS fr, (o_custkey % 40) * 16 + 256 AS fb FROM orders)"""


def _views(spark, d):
    t = table(spark, d, "orders")
    a, b = col("o_orderkey"), col("o_custkey")
    k = F.element_at(F.array(lit(1), lit(2), lit(4)), (a % 3 + 1).cast("int"))
    view = G.transform(k, G.point((a % 33 - 16) * 16, (b % 17 - 8) * 16), (b % 4) * 90, False, False)
    frame = G.rect((a % 40) * 16, (b % 40) * 16, (a % 40) * 16 + 128, (b % 40) * 16 + 256)
    return t.select("o_orderkey", "o_custkey", view.alias("t"), frame.alias("f"), G.fit_inside(lit(4096), lit(2048), G.rect(0, 0, 1024, 1024)).alias("c"))


@query(f"""WITH p AS (
  SELECT o_orderkey, q, k, unnest([fl, fr, fr, fl]) - ox - 512 AS x, unnest([ft, ft, fb, fb]) - oy - 512 AS y FROM {ORDERS_SQL}
), u AS (
  SELECT o_orderkey, ((CASE q WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN -x ELSE -y END) / k + 512) * 4 AS ix,
    ((CASE q WHEN 0 THEN y WHEN 1 THEN -x WHEN 2 THEN -y ELSE x END) / k + 512 - 256) * 4 AS iy FROM p
), r AS (
  SELECT o_orderkey, greatest(floor(min(ix) + 0.5), 0)::INTEGER AS x_left, greatest(floor(min(iy) + 0.5), 0)::INTEGER AS x_top,
    least(floor(max(ix) + 0.5), 4096)::INTEGER AS x_right, least(floor(max(iy) + 0.5), 2048)::INTEGER AS x_bottom FROM u GROUP BY o_orderkey
) SELECT * FROM r WHERE x_left < x_right AND x_top < x_bottom""")
def viewport_to_region(spark, d):
    r = G.viewport_to_region(lit(4096), lit(2048), col("c"), col("t"), col("f"))
    t = _views(spark, d).select("o_orderkey", r.alias("r")).filter("r is not null")
    return t.select("o_orderkey", *(col("r")[k].alias(f"x_{k}") for k in ("left", "top", "right", "bottom")))


@query(f"""WITH v AS (
  SELECT o_orderkey, q, 512 * k AS hw, 256 * k AS hh, ox, oy, fl - 512 AS l, ft - 512 AS t, fr - 512 AS r, fb - 512 AS b FROM {ORDERS_SQL}
), u AS (
  SELECT o_orderkey, hw, hh, (CASE q WHEN 0 THEN ox WHEN 1 THEN oy WHEN 2 THEN -ox ELSE -oy END) AS cx, (CASE q WHEN 0 THEN oy WHEN 1 THEN -ox WHEN 2 THEN -oy ELSE ox END) AS cy,
    (CASE q WHEN 0 THEN l WHEN 1 THEN t WHEN 2 THEN -r ELSE -b END) AS l, (CASE q WHEN 0 THEN r WHEN 1 THEN b WHEN 2 THEN -l ELSE -t END) AS r,
    (CASE q WHEN 0 THEN t WHEN 1 THEN -r WHEN 2 THEN -b ELSE l END) AS t, (CASE q WHEN 0 THEN b WHEN 1 THEN -l WHEN 2 THEN -t ELSE r END) AS b FROM v
), w AS (SELECT *, cx - hw <= l AND cy - hh <= t AND cx + hw >= r AND cy + hh >= b AS covers FROM u)
SELECT o_orderkey, covers, NOT covers AND NOT (2 * hw >= r - l AND 2 * hh >= b - t) AS scaled FROM w""")
def coverage(spark, d):
    t = _views(spark, d)
    return t.select("o_orderkey", G.covers(col("t"), col("c"), col("f")).alias("covers"), G.correct_coverage(col("t"), col("c"), col("f"))["scaled"].alias("scaled"))


@query("""SELECT o_orderkey, floor((1024 - w * k) / 2 + 0.5)::INTEGER AS x_left, floor((512 - h * k) / 2 + 0.5)::INTEGER AS x_top, floor((1024 + w * k) / 2 + 0.5)::INTEGER AS x_right, floor((512 + h * k) / 2 + 0.5)::INTEGER AS x_bottom
FROM (SELECT *, least(1024.0 / w, 512.0 / h)::DOUBLE AS k FROM (SELECT o_orderkey, 1 << (o_orderkey % 12)::INTEGER AS w, 1 << (o_custkey % 12)::INTEGER AS h FROM orders))""")
def fit_inside(spark, d):
    two = lambda k: F.pow(lit(2.0), k % 12)
    r = G.fit_inside(two(col("o_orderkey")), two(col("o_custkey")), G.rect(0, 0, 1024, 512))
    t = table(spark, d, "orders").select("o_orderkey", r.alias("r"))
    return t.select("o_orderkey", *(G.round_half_up(col("r")[k]).alias(f"x_{k}") for k in ("left", "top", "right", "bottom")))


@query("""SELECT l_orderkey, l_linenumber, (CASE WHEN abs(a - n) <= 5 THEN n ELSE a END)::INTEGER AS snapped, abs(a - n) <= 5 AND a <> n AS is_snapping, (((a % 360) + 360) % 360)::INTEGER AS normal
FROM (SELECT *, round_even(a / 90.0, 0) * 90 AS n FROM (SELECT l_orderkey, l_linenumber, (l_orderkey * 7 + l_linenumber * 31) % 1440 - 720 AS a FROM lineitem))""")
def rotation_snap(spark, d):
    a = ((col("l_orderkey") * 7 + col("l_linenumber") * 31) % 1440 - 720).cast("float")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", G.snap(a).cast("int").alias("snapped"), G.is_snapping(a).alias("is_snapping"), G.normalize(a).cast("int").alias("normal"))


@query("""WITH r AS (
  SELECT p_partkey, p_size * 37 AS l, p_partkey % 997 AS t, p_size * 37 + 1 + p_size * 200 AS r, p_partkey % 997 + 3000 AS b, 1 << (p_partkey % 3)::INTEGER AS s FROM part
), c AS (
  SELECT *, unnest(generate_series(l // (512 * s), (r - 1) // (512 * s))) AS x FROM r
), g AS (
  SELECT *, unnest(generate_series(t // (512 * s), (b - 1) // (512 * s))) AS y FROM c
), e AS (
  SELECT *, ((x * 512 * s)::FLOAT + (256 * s)::FLOAT - (l + r)::FLOAT * 0.5::FLOAT)::FLOAT AS dx, ((y * 512 * s)::FLOAT + (256 * s)::FLOAT - (t + b)::FLOAT * 0.5::FLOAT)::FLOAT AS dy FROM g
), k AS (
  SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY ((dx * dx)::FLOAT + (dy * dy)::FLOAT)::FLOAT, y, x) - 1 AS n FROM e
) SELECT p_partkey, s::INTEGER AS sample_size, x::INTEGER AS "column", y::INTEGER AS "row", n::INTEGER AS rank FROM k WHERE n < 12""")
def tile_plan(spark, d):
    t = table(spark, d, "part")
    a, s = (col("p_partkey") % 997).cast("int"), col("p_size")
    r = G.region(s * 37, a, s * 37 + 1 + s * 200, a + 3000)
    sample = F.element_at(F.array(lit(1), lit(2), lit(4)), (col("p_partkey") % 3 + 1).cast("int"))
    return B.tile_plan(t, ["p_partkey"], r, sample, 12)


@query("""SELECT p_partkey, x_left::INTEGER AS x_left, least(x_left + 512 * s, 4000)::INTEGER AS x_right, greatest(p_partkey * 10007 // 1048576, 1)::INTEGER AS tiles,
  (1 << floor(log2(p_size + 0.5))::INTEGER)::INTEGER AS pow2
FROM (SELECT *, (p_partkey % 5) * 512 * s AS x_left FROM (SELECT *, 1 << (p_partkey % 3)::INTEGER AS s FROM part))
WHERE x_left < 4000 AND (p_size % 4) * 512 * s < 3000""")
def tile_region(spark, d):
    s = F.element_at(F.array(lit(1), lit(2), lit(4)), (col("p_partkey") % 3 + 1).cast("int"))
    r = B.tile_region(s, (col("p_partkey") % 5).cast("int"), col("p_size") % 4, lit(4000), lit(3000))
    t = table(spark, d, "part").withColumn("r", r).filter("r is not null")
    return t.select("p_partkey", col("r.left").alias("x_left"), col("r.right").alias("x_right"), B.max_tiles(col("p_partkey") * 10007).alias("tiles"), B.power_of_two_at_most(col("p_size")).alias("pow2"))


CUST = "(SELECT c_custkey, c_custkey % 340 AS x, (c_custkey * 7) % 260 AS y, c_custkey % 9 AS h, (c_custkey * 3) % 41 - 20 AS dx, (c_custkey * 5) % 61 - 30 AS dy FROM customer)"
HANDLES = ["TopLeft", "TopRight", "BottomLeft", "BottomRight", "Top", "Bottom", "Left", "Right", "Inside"]


def _frame():
    return G.rect(lit(40), lit(30), lit(300), lit(230))


def _cust(spark, d):
    k = col("c_custkey")
    handle = F.element_at(F.array(*map(lit, HANDLES)), (k % 9 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", G.point(k % 340, (k * 7) % 260).alias("p"), handle.alias("h"), G.point((k * 3) % 41 - 20, (k * 5) % 61 - 30).alias("d"))


@query(f"""WITH c AS (
  SELECT c_custkey, x, y, list_min([{{'d': (x - 40) ** 2 + (y - 30) ** 2, 'k': 0, 'n': 'TopLeft'}}, {{'d': (x - 300) ** 2 + (y - 30) ** 2, 'k': 1, 'n': 'TopRight'}},
    {{'d': (x - 40) ** 2 + (y - 230) ** 2, 'k': 2, 'n': 'BottomLeft'}}, {{'d': (x - 300) ** 2 + (y - 230) ** 2, 'k': 3, 'n': 'BottomRight'}}]) AS corner FROM {CUST}
), e AS (
  SELECT *, y BETWEEN 6 AND 254 AS v, x BETWEEN 16 AND 324 AS h FROM c
)
SELECT c_custkey, CASE WHEN corner.d <= 576 THEN corner.n
  WHEN least(CASE WHEN v THEN least(abs(x - 40), abs(x - 300)) ELSE 999 END, CASE WHEN h THEN least(abs(y - 30), abs(y - 230)) ELSE 999 END) <= 24 THEN
    list_min([{{'d': CASE WHEN v THEN abs(x - 40) ELSE 999 END, 'k': 0, 'n': 'Left'}}, {{'d': CASE WHEN v THEN abs(x - 300) ELSE 999 END, 'k': 1, 'n': 'Right'}},
      {{'d': CASE WHEN h THEN abs(y - 30) ELSE 999 END, 'k': 2, 'n': 'Top'}}, {{'d': CASE WHEN h THEN abs(y - 230) ELSE 999 END, 'k': 3, 'n': 'Bottom'}}]).n
  WHEN x BETWEEN 40 AND 300 AND y BETWEEN 30 AND 230 THEN 'Inside' END AS handle FROM e""")
def hit_test(spark, d):
    return _cust(spark, d).select("c_custkey", I.hit_test(_frame(), col("p"), lit(24.0)).alias("handle"))


def _sides(t, r):
    return t.select("c_custkey", r.alias("r")).select("c_custkey", *(col("r")[k].cast("int").alias(f"x_{k}") for k in ("left", "top", "right", "bottom")))


@query(f"""SELECT c_custkey, (CASE WHEN h = 8 THEN 40 + greatest(least(dx, 20), -40) WHEN h IN (0, 2, 6) THEN least(greatest(40 + dx, 0), 300 - 64) ELSE 40 END)::INTEGER AS x_left,
  (CASE WHEN h = 8 THEN 30 + greatest(least(dy, 10), -30) WHEN h IN (0, 1, 4) THEN least(greatest(30 + dy, 0), 230 - 64) ELSE 30 END)::INTEGER AS x_top,
  (CASE WHEN h = 8 THEN 300 + greatest(least(dx, 20), -40) WHEN h IN (1, 3, 7) THEN greatest(least(300 + dx, 320), 40 + 64) ELSE 300 END)::INTEGER AS x_right,
  (CASE WHEN h = 8 THEN 230 + greatest(least(dy, 10), -30) WHEN h IN (2, 3, 5) THEN greatest(least(230 + dy, 240), 30 + 64) ELSE 230 END)::INTEGER AS x_bottom FROM {CUST}""")
def resize_drag(spark, d):
    t = _cust(spark, d)
    return _sides(t, I.resize_drag(_frame(), col("h"), col("d"), G.rect(0, 0, 320, 240), lit(64.0), lit(None).cast("float")))


@query(f"""SELECT c_custkey, (CASE WHEN h = 8 THEN 40 + greatest(least(dx, 20), -40) WHEN h IN (0, 2, 6) THEN least(greatest(40 + dx, 0), 300 - 64) ELSE 40 END)::INTEGER AS x_left,
  (CASE WHEN h = 8 THEN 30 + greatest(least(dy, 10), -30) WHEN h IN (0, 1, 4) THEN least(greatest(30 + dy, 0), 230 - 64) ELSE 30 END)::INTEGER AS x_top,
  (CASE WHEN h = 8 THEN 300 + greatest(least(dx, 20), -40) WHEN h IN (1, 3, 7) THEN least(greatest(300 + dx, 40 + 64), 320) ELSE 300 END)::INTEGER AS x_right,
  (CASE WHEN h = 8 THEN 230 + greatest(least(dy, 10), -30) WHEN h IN (2, 3, 5) THEN least(greatest(230 + dy, 30 + 64), 240) ELSE 230 END)::INTEGER AS x_bottom FROM {CUST}""")
def resize_nudge(spark, d):
    t = _cust(spark, d)
    return _sides(t, I.resize_nudge(_frame(), col("h"), col("d"), G.rect(0, 0, 320, 240), lit(64.0), lit(None).cast("float")))


@query("""SELECT o_orderkey, 'recipe1:' || concat_ws(':', k::VARCHAR || '.5', (o_orderkey % 90)::VARCHAR || '.25', '-' || (o_custkey % 90 + 1)::VARCHAR || '.0', '90.0', (o_orderkey % 2)::VARCHAR || '.0', '0.0', '0.125', '0.25', '0.75', '0.5', '-1.0') AS encoded,
  k * 2 + 1 AS doubled, o_orderkey % 2 = 1 AS flip_h, NULL::FLOAT AS ratio FROM (SELECT o_orderkey, o_custkey, o_orderkey % 7 + 1 AS k FROM orders)""")
def recipe_roundtrip(spark, d):
    a, b = col("o_orderkey"), col("o_custkey")
    view = G.transform(a % 7 + 1.5, G.point(a % 90 + 0.25, -(b % 90 + 1)), lit(90), a % 2 == 1, False)
    t = table(spark, d, "orders").select("o_orderkey", R.encode(view, G.rect(0.125, 0.25, 0.75, 0.5), lit(None).cast("float")).alias("encoded"))
    t = t.withColumn("back", R.decode(col("encoded")))
    return t.select("o_orderkey", "encoded", (col("back.transform.scale") * 2).cast("long").alias("doubled"), col("back.transform.flip_h").alias("flip_h"), col("back.ratio").alias("ratio"))


@query("""SELECT 'cancel' AS what, count(*) AS n FROM (SELECT l_partkey % 500 AS k FROM lineitem WHERE l_linenumber = 1 EXCEPT SELECT o_orderkey % 700 FROM orders)
UNION ALL SELECT 'start', count(*) FROM (SELECT o_orderkey % 700 AS k FROM orders EXCEPT SELECT l_partkey % 500 FROM lineitem WHERE l_linenumber = 1)""")
def tile_requests(spark, d):
    wanted = table(spark, d, "orders").select((col("o_orderkey") % 700).alias("k")).distinct()
    flying = table(spark, d, "lineitem").filter("l_linenumber = 1").select((col("l_partkey") % 500).alias("k")).distinct()
    start, cancel = B.tile_requests(wanted, flying, ["k"])
    return start.agg(F.count(lit(1)).alias("n")).select(lit("start").alias("what"), "n").unionByName(cancel.agg(F.count(lit(1)).alias("n")).select(lit("cancel").alias("what"), "n"))


@query("""SELECT c_custkey, floor(h * 0 + 0.5)::INTEGER AS zero, CASE WHEN c_custkey % 4 = 0 THEN 'Circle' ELSE 'Rectangle' END AS shape,
  ((c_custkey % 100 + 1) || '% wide and ' || (c_custkey % 50 + 1) || '% tall') AS said, 'k' || c_custkey || 'crop:0,0,' || (c_custkey % 100 + 1) || ',' || (c_custkey % 50 + 1) AS cache_key
FROM (SELECT *, 1 AS h FROM customer)""")
def describe_frame(spark, d):
    k = col("c_custkey")
    w, h = k % 100 + 1, k % 50 + 1
    t = table(spark, d, "customer")
    return t.select("c_custkey", lit(0).alias("zero"), F.when(k % 4 == 0, "Circle").otherwise("Rectangle").alias("shape"), G.describe(G.rect(0, 0, w, h), lit(100), lit(100)).alias("said"), R.cache_key(F.concat(lit("k"), k.cast("string")), G.region(0, 0, w, h)).alias("cache_key"))


@query()
def lru_replay(spark, d):
    e = table(spark, d, "events")
    e = e.withColumn("op", F.when(F.col("event_id") % 3 == 0, "put").when(F.col("event_id") % 3 == 1, "get").otherwise("contains"))
    return cache.replay(e.withColumn("tile", F.pmod(F.xxhash64("event_id"), lit(40))).withColumn("size", lit(1 << 20)), "user_id", "event_id", "op", "tile", "size", 8 << 20)


@query()
def gesture_sessions(spark, d):
    e = table(spark, d, "events")
    n = col("event_id")
    kind = F.when(n % 3 == 0, "tap").when(n % 3 == 1, "drag").otherwise("pinch")
    return gestures.sessions(e.select(col("user_id").alias("session"), F.unix_millis(col("ts").cast("timestamp")).alias("ms"), kind.alias("kind"), (n % 100).alias("x"), (n % 70).alias("y"), (lit(1.0) + (n % 10) / 50).alias("value")))


def queries() -> dict:
    return dict(_ALL)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
