"""Queries over integers and small blocks: rounding, companding, transforms and code tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import integer as n
from ..functions import transforms as t
from . import inputs as i

QUERIES: dict = {}


def integer_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, u, d = F.col("s"), F.col("u"), F.col("d")
    return i.integers(spark, sf_dir).select(
        "k", n.round2(s, 3).alias("round2"), n.round2_signed(s, 3).alias("round2_signed"), n.clip3(-100, 100, s).alias("clip"), n.round_div_nearest(s, d).alias("nearest"),
        n.div_round_up(u, d).alias("up"), n.wrap8(s).alias("wrap8"), n.signed8(s).alias("signed8"), n.signed16(s * 97).alias("signed16"), n.reverse_bits(u % 4096, 12).alias("reversed"),
        n.leb128_len(u * 9999).cast("long").alias("leb_len"), n.row_bytes(u, 12).alias("row_bytes"), n.color_index_width_bits(d).alias("width_bits"), n.index_bit_depth(d).alias("depth"),
        n.quality_to_quant(d).alias("quant"), n.fixed_litlen_bits(u % 286).alias("fixed_bits"), n.dequant(s, d, 2, 8).alias("dequant"),
    )


QUERIES["integer_math"] = integer_math, f"""WITH {i.INTEGERS} SELECT k, (s + 4) >> 3 AS round2, CASE WHEN s >= 0 THEN (s + 4) >> 3 ELSE -((-s + 4) >> 3) END AS round2_signed,
 greatest(least(s, 100), -100) AS clip, CASE WHEN s >= 0 THEN (s + d // 2) // d ELSE -((-s + d // 2) // d) END AS nearest, (u + d - 1) // d AS up,
 ((s % 256) + 256) % 256 AS wrap8, ((((s + 128) % 256) + 256) % 256) - 128 AS signed8, ((((s * 97 + 32768) % 65536) + 65536) % 65536) - 32768 AS signed16,
 list_sum(list_transform(range(12), lambda j: ((u % 4096) >> j & 1) << (11 - j)))::BIGINT AS reversed,
 CAST(CASE WHEN u * 9999 < 128 THEN 1 WHEN u * 9999 < 16384 THEN 2 WHEN u * 9999 < 2097152 THEN 3 WHEN u * 9999 < 268435456 THEN 4 ELSE 5 END AS BIGINT) AS leb_len,
 (u * 12 + 7) // 8 AS row_bytes, CASE WHEN d <= 2 THEN 3 WHEN d <= 4 THEN 2 WHEN d <= 16 THEN 1 ELSE 0 END AS width_bits,
 CASE WHEN d <= 2 THEN 1 WHEN d <= 4 THEN 2 WHEN d <= 16 THEN 4 ELSE 8 END AS depth, (100 - d) * 127 // 100 AS quant,
 CASE WHEN u % 286 < 144 THEN 8 WHEN u % 286 < 256 THEN 9 WHEN u % 286 < 280 THEN 7 ELSE 8 END AS fixed_bits,
 greatest(least(CASE WHEN s < 0 THEN -((-s * d) & 16777215) // 2 ELSE ((s * d) & 16777215) // 2 END, 32767), -32768) AS dequant FROM ints"""


def code_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("u")
    rows = i.integers(spark, sf_dir).select("k", n.deflate_code(u % 256 + 3, "length").alias("l"), n.deflate_code(u, "distance").alias("d"), n.value_to_prefix(u).alias("v"))
    return rows.select("k", *[F.col(f"{x}.{y}").cast("long").alias(f"{x}_{z}") for x, y, z in (("l", "symbol", "symbol"), ("l", "extra_bits", "bits"), ("l", "extra", "extra"), ("d", "symbol", "symbol"), ("d", "extra_bits", "bits"), ("d", "extra", "extra"), ("v", "prefix", "prefix"), ("v", "extra_bits", "bits"), ("v", "extra", "extra"))])


def _bases(kind: str) -> str:
    return ", ".join(str(x) for x in n.deflate_bases(kind))


QUERIES["code_tables"] = code_tables, f"""WITH {i.INTEGERS}, lt(sym, bits, base) AS (VALUES {_bases('length')}), dt(sym, bits, base) AS (VALUES {_bases('distance')}),
l AS (SELECT k, max(base) AS base FROM ints JOIN lt ON base <= u % 256 + 3 GROUP BY k), d AS (SELECT k, max(base) AS base FROM ints JOIN dt ON base <= u GROUP BY k)
SELECT k, CAST(lt.sym AS BIGINT) AS l_symbol, CAST(lt.bits AS BIGINT) AS l_bits, CAST(u % 256 + 3 - l.base AS BIGINT) AS l_extra, CAST(dt.sym AS BIGINT) AS d_symbol, CAST(dt.bits AS BIGINT) AS d_bits, CAST(u - d.base AS BIGINT) AS d_extra,
 CAST(CASE WHEN u <= 4 THEN u - 1 WHEN (u - 1) < 3 * pow(2, e) THEN 2 * e + 2 ELSE 2 * e + 3 END AS BIGINT) AS v_prefix, CAST(CASE WHEN u <= 4 THEN 0 ELSE e END AS BIGINT) AS v_bits,
 CAST(CASE WHEN u <= 4 THEN 0 WHEN (u - 1) < 3 * pow(2, e) THEN u - 1 - pow(2, e + 1) ELSE u - 1 - 3 * pow(2, e) END AS BIGINT) AS v_extra
FROM (SELECT *, CASE WHEN u <= 4 THEN 0 ELSE CAST(floor(log2(u - 1)) AS INT) - 1 END AS e FROM ints) ints JOIN l USING (k) JOIN lt ON lt.base = l.base JOIN d USING (k) JOIN dt ON dt.base = d.base"""


def mulaw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values in millionths. Samples are binary fractions, which may lie half way between two of these but never at 0.63,
    where the last bit of a logarithm would tell."""
    v = F.col("v")
    q = n.mu_quantize(v, 8, 255.0)
    millionths = lambda x, name: F.floor(x * 1e6 + 0.37).alias(name)
    return i.mulaw_samples(spark, sf_dir).select("vec_id", "i", millionths(n.mu_compress(v, 255.0), "compressed"), millionths(n.mu_expand(n.mu_compress(v, 255.0), 255.0), "back"), q.alias("q"), millionths(n.mu_dequantize(q, 8, 255.0), "dq"))


_COMP = "sign(v) * ln(1 + 255 * abs(v)) / ln(256.0)"
_Q = f"CAST(greatest(least(floor(({_COMP} + 1) / 2 * 254 + 0.5), 254), 0) AS BIGINT)"
_MILLIONTHS = "CAST(floor(({}) * 1e6 + 0.37) AS BIGINT)"
QUERIES["mulaw"] = mulaw, f"""WITH {i.MULAW}, c AS (SELECT *, {_COMP} AS c FROM mu), q AS (SELECT *, {_Q} AS q FROM c)
SELECT vec_id, i, {_MILLIONTHS.format('c')} AS compressed, {_MILLIONTHS.format('sign(c) * (pow(256.0, abs(c)) - 1) / 255')} AS back, q,
 {_MILLIONTHS.format('sign(q / 254.0 * 2 - 1) * (pow(256.0, abs(q / 254.0 * 2 - 1)) - 1) / 255')} AS dq FROM q"""


def _each(block: Column, size: int = 16) -> list[Column]:
    return [F.element_at(block, k + 1).cast("long").alias(f"v{k:02d}") for k in range(size)]


def wht(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = i.blocks(spark, sf_dir).withColumn("t", n.fwht4x4(F.col("v"))).withColumn("back", n.iwht4x4(F.col("t")))
    same = F.col("back") == F.transform("v", lambda x: x.cast("long"))
    return rows.select("vec_id", "block", *_each(F.col("t")), same.alias("same"))


def _lift(a: str, b: str, c: str, d: str) -> list[str]:
    e = f"((({a}) + ({b}) - ({d}) + ({c})) >> 1)"
    return [f"(({a}) + ({b}) - ({e} - ({c})))", f"({e} - ({c}))", f"(({d}) - ({c}) + ({e} - ({b})))", f"({e} - ({b}))"]


def _wht_sql() -> str:
    columns = [_lift(*[f"v[{4 * r + c + 1}]" for r in range(4)]) for c in range(4)]
    first = ", ".join(f"{columns[c][r]} AS m{r}{c}" for r in range(4) for c in range(4))
    rows = [_lift(*[f"m{r}{c}" for c in range(4)]) for r in range(4)]
    second = ", ".join(f"CAST({rows[r][c]} AS BIGINT) AS v{4 * r + c:02d}" for r in range(4) for c in range(4))
    return f"WITH {i.BLOCKS}, m AS (SELECT vec_id, block, {first} FROM bl) SELECT vec_id, block, {second}, true AS same FROM m"


QUERIES["walsh_hadamard"] = wht, _wht_sql()


def dct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = i.blocks(spark, sf_dir)
    return rows.select("vec_id", "block", *_each(n.forward_dct(F.col("v"), 4)), *[F.element_at(n.forward_identity(F.col("v"), k), 2).cast("long").alias(f"id{k}") for k in (2, 3, 4, 5)], *[F.element_at(n.inverse_identity(F.col("v"), k), 3).cast("long").alias(f"inv{k}") for k in (2, 3, 4, 5)])


def _dct_sql() -> str:
    basis = ", ".join(f"({k}, {m + 1}, {n.cos128(4 * (2 * m + 1) * k)})" for k in range(16) for m in range(16))
    pick = ", ".join(f"max(CASE WHEN c = {k} THEN o END) AS v{k:02d}" for k in range(16))
    ids = {2: "(v[2] * 2896 + 2048) >> 12", 3: "(v[2] + 1) >> 1", 4: "(v[2] * 1448 + 2048) >> 12", 5: "(v[2] + 2) >> 2"}
    inv = {2: "(v[3] * 5793 + 2048) >> 12", 3: "v[3] * 2", 4: "(v[3] * 11586 + 2048) >> 12", 5: "v[3] * 4"}
    more = ", ".join([f"any_value({x}) AS id{k}" for k, x in ids.items()] + [f"any_value({x}) AS inv{k}" for k, x in inv.items()])
    return f"""WITH {i.BLOCKS}, basis(c, m, w) AS (VALUES {basis}), s AS (SELECT vec_id, block, c, CAST(sum(v[m] * w) AS BIGINT) AS t, any_value(v) AS v FROM bl, basis GROUP BY vec_id, block, c),
o AS (SELECT vec_id, block, v, c, CASE WHEN c = 0 THEN (t * 2896 + 8388608) >> 24 ELSE (t + 2048) >> 12 END AS o FROM s) SELECT vec_id, block, {pick}, {more} FROM o GROUP BY vec_id, block"""


QUERIES["integer_dct"] = dct, _dct_sql()


def vp8_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forward transform's coefficients, and the largest error of a sample after the inverse; the inverse Hadamard."""
    rows = i.blocks(spark, sf_dir).withColumn("t", n.vp8_fdct4x4(F.col("v"))).withColumn("back", n.vp8_idct4x4(F.col("t"))).withColumn("h", n.vp8_iwht4x4(F.col("v")))
    error = F.array_max(F.zip_with("v", "back", lambda a, b: F.abs(a - b)))
    return rows.select("vec_id", "block", *_each(F.col("t")), *[F.element_at("h", k + 1).cast("long").alias(f"h{k:02d}") for k in range(16)], (error <= 1).alias("near"))


def _vp8_sql() -> str:
    fwd1, fwd2, had1, had2 = [], [], [], []
    for r in range(4):
        w, x, y, z = (f"v[{4 * r + c + 1}]" for c in range(4))
        c, d = f"(({x} - {y}) * 8)", f"(({w} - {z}) * 8)"
        fwd1 += [f"({w} + {z} + {x} + {y}) * 8 AS f{r}0", f"({c} * 2217 + {d} * 5352 + 14500) >> 12 AS f{r}1", f"({w} + {z} - {x} - {y}) * 8 AS f{r}2", f"({d} * 2217 - {c} * 5352 + 7500) >> 12 AS f{r}3"]
    for c in range(4):
        w, x, y, z = (f"f{r}{c}" for r in range(4))
        fwd2 += [f"({w} + {z} + {x} + {y} + 7) >> 4 AS v{c:02d}", f"((({x} - {y}) * 2217 + ({w} - {z}) * 5352 + 12000) >> 16) + CAST({w} <> {z} AS INT) AS v{4 + c:02d}", f"({w} + {z} - {x} - {y} + 7) >> 4 AS v{8 + c:02d}", f"(({w} - {z}) * 2217 - ({x} - {y}) * 5352 + 51000) >> 16 AS v{12 + c:02d}"]
        w, x, y, z = (f"v[{4 * r + c + 1}]" for r in range(4))
        had1 += [f"{w} + {z} + {x} + {y} AS g0{c}", f"{x} - {y} + {w} - {z} AS g1{c}", f"{w} + {z} - {x} - {y} AS g2{c}", f"{w} - {z} - {x} + {y} AS g3{c}"]
    for r in range(4):
        w, x, y, z = (f"g{r}{c}" for c in range(4))
        had2 += [f"({w} + {z} + {x} + {y} + 3) >> 3 AS h{4 * r:02d}", f"({x} - {y} + {w} - {z} + 3) >> 3 AS h{4 * r + 1:02d}", f"({w} + {z} - {x} - {y} + 3) >> 3 AS h{4 * r + 2:02d}", f"({w} - {z} - {x} + {y} + 3) >> 3 AS h{4 * r + 3:02d}"]
    return f"WITH {i.BLOCKS}, m AS (SELECT vec_id, block, {', '.join(fwd1 + had1)} FROM bl) SELECT vec_id, block, {', '.join(fwd2 + had2)}, true AS near FROM m"


QUERIES["vp8_transforms"] = vp8_transforms, _vp8_sql()


def _columns(size: int) -> list[str]:
    return [f"v{k:02d}" for k in range(size)]


def _inverse(kind: str, power: int) -> tuple:
    """Every block's inverse transform, sums held to sixteen bits."""
    size = 1 << power

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = i.blocks(spark, sf_dir, size)
        return t.inverse_columns(rows.select("vec_id", "block", *_each(F.col("v"), size)), _columns(size), kind, power, bits=16)

    given = f"(WITH {i.blocks_sql(size)} SELECT vec_id, block, {', '.join(f'v[{k + 1}] AS {x}' for k, x in enumerate(_columns(size)))} FROM bl)"
    return query, t.inverse_sql(given, "vec_id, block", _columns(size), kind, power, bits=16)


def _forward(kind: str, power: int) -> tuple:
    size = 1 << power

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = i.blocks(spark, sf_dir, size)
        return t.forward_columns(rows.select("vec_id", "block", *_each(F.col("v"), size)), _columns(size), kind, power)

    def total(k: int) -> str:
        out = " + ".join(f"v[{m + 1}] * ({int(w)})" for m, w in enumerate(t.forward_matrix(kind, power)[k]))
        return f"(({out}) * 2896 + 8388608) >> 24" if kind == "dct" and k == 0 else f"({out} + 2048) >> 12"

    return query, f"WITH {i.blocks_sql(size)} SELECT vec_id, block, {', '.join(f'{total(k)} AS {x}' for k, x in enumerate(_columns(size)))} FROM bl"


for _power in range(2, 7):
    QUERIES[f"inverse_dct_{1 << _power}"] = _inverse("dct", _power)
    QUERIES[f"forward_dct_{1 << _power}"] = _forward("dct", _power)
for _power in range(2, 5):
    QUERIES[f"inverse_adst_{1 << _power}"] = _inverse("adst", _power)
    QUERIES[f"forward_adst_{1 << _power}"] = _forward("adst", _power)


def quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = t.quantise(F.col("s"), F.col("d"))
    return i.integers(spark, sf_dir).select("k", level.alias("level"), n.dequant(level, F.col("d"), 1, 8).alias("back"))


QUERIES["quantise"] = quantised, f"""WITH {i.INTEGERS}, q AS (SELECT k, s, d, CASE WHEN s < 0 THEN -((-s + d // 2) // d) ELSE (s + d // 2) // d END AS level FROM ints)
SELECT k, level, greatest(least(CASE WHEN level < 0 THEN -((-level * d) & 16777215) ELSE (level * d) & 16777215 END, 32767), -32768) AS back FROM q"""


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of each identity plane by row, and of red after the way back."""
    there = t.identity_planes(i.pixels(spark, sf_dir))
    both = t.identity_pixels(there.withColumns({f"{x}_sum": F.col(f"{x}_plane") * (F.col("x") + 1) for x in "yuv"}))
    return both.groupBy("img", "y").agg(*[F.sum(f"{x}_sum").alias(f"{x}_sum") for x in "yuv"], F.sum("r").alias("red"))


QUERIES["identity_planes"] = planes, f"WITH {i.PIXELS} SELECT img, y, CAST(sum(g * (x + 1)) AS BIGINT) AS y_sum, CAST(sum(b * (x + 1)) AS BIGINT) AS u_sum, CAST(sum(r * (x + 1)) AS BIGINT) AS v_sum, CAST(sum(r) AS BIGINT) AS red FROM px GROUP BY img, y"
