"""Queries over the relational parts of block codecs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.integer import div
from ..operators import video as v
from . import inputs as i

QUERIES: dict = {}
_STEPS = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(zip(v.DC_STEPS, v.AC_STEPS, strict=True)))


def quantisers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, d = F.col("s"), F.col("d")
    rows = i.integers(spark, sf_dir).withColumn("base", v.segment_index(d, (s % 60).cast("int"), d % 3 == 0, d % 5 != 0))
    deltas = {name: (F.col("k") * m % 31 - 15) for name, m in (("y_dc", 3), ("y2_dc", 5), ("y2_ac", 7), ("uv_dc", 11), ("uv_ac", 13))}
    level = v.segment_index(d % 64, s % 20, d % 2 == 0, d % 7 != 0, top=63)
    return rows.select("k", F.col("base").cast("long").alias("base"), *[x.cast("long").alias(n) for n, x in v.quantiser_factors(F.col("base"), deltas).items()], level.cast("long").alias("level"), v.interior_limit(d % 64, d % 8).cast("long").alias("interior"), v.edge_variance_threshold(d % 64).cast("long").alias("hev"))


def _look(q: str, c: str) -> str:
    return f"(SELECT {c} FROM st WHERE st.q = greatest(least({q}, 127), 0))"


QUERIES["quantiser_factors"] = quantisers, f"""WITH {i.INTEGERS}, st(q, dc, ac) AS (VALUES {_STEPS}),
b AS (SELECT *, CASE WHEN d % 5 = 0 THEN d ELSE greatest(least(CASE WHEN d % 3 = 0 THEN s % 60 ELSE d + s % 60 END, 127), 0) END AS base FROM ints)
SELECT k, CAST(base AS BIGINT) AS base, CAST({_look('base + k * 3 % 31 - 15', 'dc')} AS BIGINT) AS y1_dc, CAST({_look('base', 'ac')} AS BIGINT) AS y1_ac, CAST({_look('base + k * 5 % 31 - 15', 'dc')} * 2 AS BIGINT) AS y2_dc,
 CAST(greatest({_look('base + k * 7 % 31 - 15', 'ac')} * 155 // 100, 8) AS BIGINT) AS y2_ac, CAST(least({_look('base + k * 11 % 31 - 15', 'dc')}, 132) AS BIGINT) AS uv_dc, CAST({_look('base + k * 13 % 31 - 15', 'ac')} AS BIGINT) AS uv_ac,
 CAST(CASE WHEN d % 7 = 0 THEN d % 64 ELSE greatest(least(CASE WHEN d % 2 = 0 THEN s % 20 ELSE d % 64 + s % 20 END, 63), 0) END AS BIGINT) AS level,
 CAST(greatest(CASE WHEN d % 8 > 0 THEN least((d % 64) >> CASE WHEN d % 8 > 4 THEN 2 ELSE 1 END, 9 - d % 8) ELSE d % 64 END, 1) AS BIGINT) AS interior,
 CAST(CASE WHEN d % 64 >= 40 THEN 2 WHEN d % 64 >= 15 THEN 1 ELSE 0 END AS BIGINT) AS hev FROM b"""


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = i.pixels(spark, sf_dir).select("img", "p", F.col("r").alias("v"))
    return v.edge_masks(samples, i.WIDTH, 8, F.lit(40), F.lit(100), F.lit(30))


_T = ", ".join(f"max(CASE WHEN x = {4 + k} THEN r END) AS t{k}" for k in range(8))
QUERIES["loop_filter_masks"] = masks, f"""WITH {i.PIXELS}, t AS (SELECT img, y, {_T} FROM px GROUP BY img, y)
SELECT img, y, abs(t3 - t4) * 2 + abs(t2 - t5) // 2 <= 100 AND {' AND '.join(f'abs(t{a} - t{a + 1}) <= 40' for a in (0, 1, 2, 4, 5, 6))} AS smooth, abs(t2 - t3) > 30 OR abs(t5 - t4) > 30 AS variance FROM t"""


def directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.block_directions(i.pixels(spark, sf_dir).select("img", "p", F.col("b").alias("v")), i.WIDTH)


QUERIES["block_directions"] = directions, f"""WITH {i.PIXELS}, c AS (SELECT img, x // 8 AS bx, y // 8 AS yb, x % 8 AS x, y % 8 AS y, b - 128 AS v FROM px),
l AS (SELECT img, bx, yb, d, CASE d WHEN 0 THEN y + x WHEN 1 THEN y + x // 2 WHEN 2 THEN y WHEN 3 THEN y + 3 - x // 2 WHEN 4 THEN y + 7 - x WHEN 5 THEN x + 3 - y // 2 WHEN 6 THEN x ELSE x + y // 2 END AS k, v FROM c, range(8) t(d)),
s AS (SELECT img, bx, yb, d, k, sum(v) AS s, count(*) AS n FROM l GROUP BY ALL), w AS (SELECT img, bx, yb, d, CAST(sum(s * s * (840 // n)) AS BIGINT) AS cost FROM s GROUP BY ALL),
m AS (SELECT img, bx, yb, max(cost) AS best, CAST(arg_min(d, -cost * 8 + d) AS INT) AS dir FROM w GROUP BY ALL)
SELECT m.img, m.bx, m.yb AS "by", CASE WHEN best > 0 THEN dir ELSE 0 END AS direction, CAST((best - w.cost) >> 10 AS BIGINT) AS variance FROM m JOIN w ON w.img = m.img AND w.bx = m.bx AND w.yb = m.yb AND w.d = (m.dir + 4) % 8"""


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = i.few_colours(spark, sf_dir)
    return v.cache_hits(c.select("img", "p", (F.col("a").cast("long") * 16777216 + F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).alias("colour")), 6)


QUERIES["colour_cache"] = cache, f"""WITH {i.FEW}, c AS (SELECT img, p, CAST(a AS BIGINT) * 16777216 + r * 65536 + g * 256 + b AS colour FROM fx), s AS (SELECT *, CAST(((colour * 506832829) & 4294967295) >> 26 AS INT) AS slot FROM c)
SELECT img, p, slot, coalesce(lag(colour) OVER (PARTITION BY img, slot ORDER BY p), 0) = colour AS hit FROM s"""


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short codes of pixel distances: the first offset whose distance fits, else the distance plus 120."""
    near = spark.createDataFrame([(k + 1, x, y) for k, (x, y) in enumerate(v.neighbourhood())], "code int, dx int, dy int")
    rows = i.integers(spark, sf_dir).select("k", (F.col("u") % 2000 + 1).alias("dist"), (F.col("d") + 3).alias("width"))
    joined = rows.join(F.broadcast(near), F.col("dist") == F.greatest(F.col("dx") + F.col("dy") * F.col("width"), F.lit(1)), "left")
    return joined.groupBy("k", "dist", "width").agg(F.min("code").alias("code")).select("k", F.coalesce(F.col("code").cast("long"), F.col("dist") + 120).alias("code"))


QUERIES["distance_codes"] = distances, f"""WITH {i.INTEGERS}, nb(code, dx, dy) AS (VALUES {', '.join(f'({k + 1}, {x}, {y})' for k, (x, y) in enumerate(v.neighbourhood()))}),
r AS (SELECT k, u % 2000 + 1 AS dist, d + 3 AS width FROM ints) SELECT k, CAST(coalesce((SELECT min(code) FROM nb WHERE greatest(dx + dy * width, 1) = dist), dist + 120) AS BIGINT) AS code FROM r"""


def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = i.pixels(spark, sf_dir).select("img", "p", F.explode(F.array(F.struct(F.lit(0).alias("plane"), (F.col("r") * 16).alias("v")), F.struct(F.lit(1).alias("plane"), (F.col("g") * 16).alias("v")))).alias("s")).select("img", "p", "s.*")
    return v.linear_preview(planes, i.WIDTH, 2, 100, 4095)


QUERIES["linear_preview"] = previews, f"""WITH {i.PIXELS}, m AS (SELECT img, x // 2 AS px, y // 2 AS py, sum(r * 16) // count(*) AS a, sum(g * 16) // count(*) AS c FROM px GROUP BY ALL)
SELECT img, m.px AS px, py, CAST(ch AS INT) AS channel, CAST(least(greatest((CASE WHEN ch = 0 THEN a ELSE c END) - 100, 0) * 255 // 3995, 255) AS INT) AS v FROM m, range(3) t(ch)"""


def narrowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.downscale_rows(i.pixels(spark, sf_dir).select("img", "p", F.col("g").alias("v")), i.WIDTH, 11)


QUERIES["downscaled_rows"] = narrowed, f"WITH {i.PIXELS} SELECT img, px.y, t.x, CAST(sum(g) // count(*) AS INT) AS v FROM px, range(11) t(x) WHERE px.x >= t.x * 16 // 11 AND px.x < least((t.x + 1) * 16 // 11, 16) GROUP BY ALL"


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = i.pixels(spark, sf_dir)
    return v.modal_groups(px.select("img", (div(F.col("y"), 4) * 4 + div(F.col("x"), 4)).alias("block"), div(F.col("g"), 64).alias("symbol")))


QUERIES["modal_groups"] = groups, f"""WITH {i.PIXELS}, c AS (SELECT img, y // 4 * 4 + x // 4 AS block, g // 64 AS symbol, count(*) AS n FROM px GROUP BY ALL), m AS (SELECT img, block, arg_min(symbol, symbol - n * 1000) AS symbol FROM c GROUP BY ALL),
f AS (SELECT *, min(block) OVER (PARTITION BY img, symbol) AS f FROM m) SELECT img, CAST(block AS BIGINT) AS block, CAST(symbol AS BIGINT) AS symbol, CAST(dense_rank() OVER (PARTITION BY img ORDER BY f) - 1 AS BIGINT) AS grp FROM f"""


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rationals of doubles, and merged neighbour palettes."""
    rows = i.linear_rgb(spark, sf_dir)
    x = F.col("r") - 0.5
    up, left = (F.array_sort(F.array_distinct(F.array(*[(F.col("k") * m % 9).cast("int") for m in ms]))) for ms in ((1, 2, 3), (4, 5, 7)))
    return rows.select("k", "n", v.rational(x)["num"].alias("s"), v.rational(x, signed=False)["num"].alias("u"), F.array_join(v.merge_palettes(up, left), ",").alias("palette"))


QUERIES["rationals_and_palettes"] = tags, f"""WITH {i.RGB} SELECT k, n, CAST(round((r - 0.5) * 1000000) AS BIGINT) AS s, CAST(round(greatest(r - 0.5, 0) * 1000000) AS BIGINT) AS u,
 array_to_string(list_sort(list_distinct([k * 1 % 9, k * 2 % 9, k * 3 % 9, k * 4 % 9, k * 5 % 9, k * 7 % 9])), ',') AS palette FROM rgb"""
