"""Queries over colours: transfer curves, OKLab, space mapping, YCbCr, profiles and tone curves."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color as c
from ..functions import tone
from . import inputs as i

#: Name to (query, SQL).
QUERIES: dict = {}


def rounded(x: Column, name: str, digits: int = 6) -> Column:
    return (F.round(x.cast("double"), digits) + 0.0).alias(name)


def transfer_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("b")
    return i.linear_rgb(spark, sf_dir).select(
        "k", "n", rounded(c.srgb_eotf(x), "srgb"), rounded(c.srgb_oetf(x), "srgb_inv"), rounded(c.adobe_rgb_eotf(x), "adobe"), rounded(c.adobe_rgb_eotf(x, standard=True), "adobe_std"),
        rounded(c.prophoto_rgb_eotf(x), "prophoto"), rounded(c.prophoto_rgb_eotf(x, standard=True), "prophoto_std"), rounded(c.pq_eotf(x), "pq", 3), rounded(c.bt2020_pq_to_sdr(x), "pq_sdr"),
        rounded(c.eotf_for(F.element_at(F.array(*[F.lit(v) for v in (1, 13, 14, 16, 18)]), (F.col("n") % 5 + 1).cast("int")), x), "by_code"),
    )


_SRGB = "CASE WHEN {x} <= 0.04045 THEN {x} / 12.92 ELSE pow(({x} + 0.055) / 1.055, 2.4) END"
_PQ = "10000.0 * pow(greatest(pow({x}, 1 / 78.84375) - 0.8359375, 0.0) / (18.8515625 - 18.6875 * pow({x}, 1 / 78.84375)), 1 / 0.1593017578125)"
_SDR = f"(({_PQ}) / 203.0) / (1 + ({_PQ}) / 203.0)"
QUERIES["color_transfer_curves"] = transfer_curves, f"""WITH {i.RGB} SELECT k, n, round({_SRGB.format(x='b')}, 6) AS srgb,
 round(CASE WHEN b <= 0.0031308 THEN 12.92 * b ELSE 1.055 * pow(b, 1 / 2.4) - 0.055 END, 6) AS srgb_inv, round(pow(b, 2.2), 6) AS adobe,
 round(pow(b, 563.0 / 256), 6) AS adobe_std, round(pow(b, 1.8), 6) AS prophoto, round(CASE WHEN b < 1.0 / 32 THEN b / 16 ELSE pow(b, 1.8) END, 6) AS prophoto_std,
 round({_PQ.format(x='b')}, 3) AS pq, round({_SDR.format(x='b')}, 6) AS pq_sdr,
 round(CASE n % 5 WHEN 1 THEN {_SRGB.format(x='b')} WHEN 2 THEN {_SDR.format(x='b')} WHEN 3 THEN {_SDR.format(x='b')} END, 6) AS by_code FROM rgb"""


def _no_minus_zero(sql: str, *names: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'{x} + 0.0 AS {x}' for x in names)}) FROM ({sql})"


def _sum(row: tuple, names: str = "rgb") -> str:
    return " + ".join(f"({v!r}) * {x}" for v, x in zip(row, names, strict=True))


def _lms(k: int) -> str:
    return "cbrt(CASE space " + " ".join(f"WHEN '{g}' THEN {_sum(m[k])}" for g, m in c.M1.items()) + " END)"


_LAB = f"lab AS (SELECT k, n, r, g, b, space, {', '.join(f'{_sum(row, ("u", "v", "w"))} AS {name}' for row, name in zip(c.M2, ('l', 'ca', 'cb'), strict=True))} FROM (SELECT *, {_lms(0)} AS u, {_lms(1)} AS v, {_lms(2)} AS w FROM rgb))"


def _back(l: str, a: str, b: str) -> list[str]:
    cubes = [f"pow({_sum(row, (l, a, b))}, 3)" for row in c.M2_INV]
    return [_sum(row, cubes) for row in c.M1_INV_SRGB]


def oklab(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = i.linear_rgb(spark, sf_dir)
    lab = c.linear_rgb_to_oklab([F.col(x) for x in "rgb"], F.col("space"))
    rows = rows.select("k", "n", *[x.alias(name) for x, name in zip(lab, ("l", "ca", "cb"), strict=True)])
    back = c.oklab_to_linear_srgb([F.col(x) for x in ("l", "ca", "cb")])
    return rows.select("k", "n", *[rounded(F.col(x), x) for x in ("l", "ca", "cb")], *[rounded(x, name, 5) for x, name in zip(back, ("sr", "sg", "sb"), strict=True)])


QUERIES["color_oklab"] = oklab, _no_minus_zero(f"WITH {i.RGB}, {_LAB} SELECT k, n, round(l, 6) AS l, round(ca, 6) AS ca, round(cb, 6) AS cb, {', '.join(f'round({x}, 5) AS {name}' for x, name in zip(_back('l', 'ca', 'cb'), ('sr', 'sg', 'sb'), strict=True))} FROM lab", "l", "ca", "cb", "sr", "sg", "sb")


def space_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = i.linear_rgb(spark, sf_dir)
    lab = c.linear_rgb_to_oklab([F.col(x) for x in "rgb"], F.col("space"))
    rows = rows.select("k", "n", *[x.alias(name) for x, name in zip(lab, ("l", "ca", "cb"), strict=True)])
    own = [F.col(x) for x in ("l", "ca", "cb")]
    rows = rows.withColumn("inside", c.in_space(c.oklab_to_linear_srgb(own)))
    rows = c.soft_clamp(rows, ("l", "ca", "cb"), 0.5, out=("ol", "oa", "ob"))
    return rows.select("k", "n", "inside", *[rounded(F.col(x), y, 4) for x, y in (("ol", "l"), ("oa", "ca"), ("ob", "cb"))])


def _inside(l: str, a: str, b: str) -> str:
    return "(" + " AND ".join(f"({x}) BETWEEN 0 AND 1" for x in _back(l, a, b)) + ")"


_CLAMP = f"""WITH RECURSIVE {i.RGB}, {_LAB}, st AS (
 SELECT k, n, l, ca, cb, {_inside('l', 'ca', 'cb')} AS inside, CAST(0.0 AS DOUBLE) AS lo, CAST(1.0 AS DOUBLE) AS hi, 0 AS step FROM lab
 UNION ALL SELECT k, n, l, ca, cb, inside, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END, step + 1
 FROM (SELECT *, {_inside('(l + 0.5 * (0.5 - l) * mid)', '(ca * (1 - mid))', '(cb * (1 - mid))')} AS ok FROM (SELECT *, (lo + hi) / 2 AS mid FROM st WHERE step < 16)))
SELECT k, n, inside, round(CASE WHEN inside THEN l ELSE l + 0.5 * (0.5 - l) * hi END, 4) AS l, round(CASE WHEN inside THEN ca ELSE ca * (1 - hi) END, 4) AS ca,
 round(CASE WHEN inside THEN cb ELSE cb * (1 - hi) END, 4) AS cb FROM st WHERE step = 16"""
QUERIES["color_space_clamp"] = space_clamp, _no_minus_zero(_CLAMP, "l", "ca", "cb")


def matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The literal matrices against those derived from the primaries: the largest difference by space."""
    rows = [(g, max(abs(x - y) for a, b in zip(c.derive_m1(g), c.M1[g], strict=True) for x, y in zip(a, b, strict=True)) < 1e-6) for g in c.SPACES]
    return spark.createDataFrame(rows, "space string, same boolean")


QUERIES["color_derived_matrices"] = matrices, "SELECT unnest(['srgb', 'display_p3', 'adobe_rgb', 'bt2020', 'prophoto_rgb']) AS space, true AS same"


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours by profile: a dimension table of five rows joined by name, then its curve and OKLab."""
    known = spark.createDataFrame(c.PROFILES, "space string, own_space string, transfer string, primaries int, code int, white double")
    rows = i.linear_rgb(spark, sf_dir).join(F.broadcast(known), "space")
    linear = [c.profile_eotf(F.col("transfer"), F.col(x)) for x in "rgb"]
    lab = c.linear_rgb_to_oklab(linear, F.col("space"))
    return rows.select("k", "n", "primaries", "code", "white", *[rounded(x, name, 5) for x, name in zip(lab, ("l", "ca", "cb"), strict=True)])


def _curve(x: str) -> str:
    return f"CASE transfer WHEN 'srgb' THEN {_SRGB.format(x=x)} WHEN 'adobe_rgb' THEN pow({x}, 2.2) WHEN 'prophoto_rgb' THEN pow({x}, 1.8) ELSE {_SDR.format(x=x)} END"


def _value(v: object) -> str:
    return "NULL" if v is None else repr(v)


QUERIES["color_profiles"] = profiles, _no_minus_zero(f"""WITH {i.RGB.replace('rgb AS', 'raw AS')}, prof(space, transfer, primaries, code, white) AS (VALUES {', '.join('(' + ', '.join(_value(v) for v in (p[0], *p[2:])) + ')' for p in c.PROFILES)}),
rgb AS (SELECT k, n, space, primaries, code, white, {', '.join(f'{_curve(x)} AS {x}' for x in 'rgb')} FROM raw JOIN prof USING (space)), {_LAB}
SELECT lab.k, lab.n, CAST(primaries AS INT) AS primaries, CAST(code AS INT) AS code, CAST(white AS DOUBLE) AS white, round(l, 5) AS l, round(ca, 5) AS ca, round(cb, 5) AS cb FROM lab JOIN prof USING (space)""", "l", "ca", "cb")


def ycbcr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = i.pixels(spark, sf_dir, None)
    out = ["img", "p"]
    for range_ in ("full", "limited"):
        ycc = c.rgb_to_ycbcr([F.col(x) for x in "rgb"], range_)
        rows = rows.withColumns({f"{range_}_{n}": v for n, v in zip(("y", "cb", "cr"), ycc, strict=True)})
        back = c.ycbcr_to_rgb([F.col(f"{range_}_{n}") for n in ("y", "cb", "cr")], range_)
        rows = rows.withColumns({f"{range_}_{n}": v for n, v in zip("rgb", back, strict=True)})
        out += [f"{range_}_{n}" for n in ("y", "cb", "cr", "r", "g", "b")]
    return rows.select(*out)


def _clip(x: str) -> str:
    return f"CAST(greatest(least({x}, 255), 0) AS INT)"


def _ycc(range_: str) -> dict[str, str]:
    rows = {"full": ((19595, 38470, 7471, 32768), (-11059, -21709, 32768, 8421376), (32768, -27439, -5329, 8421376)), "limited": ((16839, 33059, 6420, 1081344), (-9719, -19081, 28800, 8421376), (28800, -24116, -4684, 8421376))}[range_]
    return {n: _clip(f"(({a}) * r + ({b}) * g + ({d}) * b + {e}) >> 16") for n, (a, b, d, e) in zip(("y", "cb", "cr"), rows, strict=True)}


_FULL_BACK = {"r": "full_y + ((91881 * (full_cr - 128) + 32768) >> 16)", "g": "full_y + ((-22554 * (full_cb - 128) - 46802 * (full_cr - 128) + 32768) >> 16)", "b": "full_y + ((116130 * (full_cb - 128) + 32768) >> 16)"}
_LIM_BACK = {
    "r": "(((limited_y * 19077) >> 8) + ((limited_cr * 26149) >> 8) - 14234) >> 6",
    "g": "(((limited_y * 19077) >> 8) - ((limited_cb * 6419) >> 8) - ((limited_cr * 13320) >> 8) + 8708) >> 6",
    "b": "(((limited_y * 19077) >> 8) + ((limited_cb * 33050) >> 8) - 17685) >> 6",
}
QUERIES["color_ycbcr"] = ycbcr, f"""WITH {i.PIXELS}, yc AS (SELECT img, p, {', '.join(f'{v} AS {rg}_{n}' for rg in ('full', 'limited') for n, v in _ycc(rg).items())} FROM px)
SELECT yc.*, {', '.join(f'{_clip(v)} AS full_{n}' for n, v in _FULL_BACK.items())}, {', '.join(f'{_clip(v)} AS limited_{n}' for n, v in _LIM_BACK.items())} FROM yc"""


CURVES = {
    "linear": {}, "clamp": {"max_value": 4.0}, "reinhard": {}, "reinhard_extended": {}, "exposure": {"stops": -1.0}, "aces": {}, "hable": {}, "drago": {"world_max": 25.0},
}


#: Both engines round a last place of single precision differently in chains of divisions and powers.
DIGITS = {"hable": 2, "drago": 2}


def tone_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return i.hdr(spark, sf_dir).select("k", *[rounded(tone.tone_curve(name, **args)(x), name, DIGITS.get(name, 4)) for name, args in CURVES.items()])


def _f(v: float) -> str:
    return f"CAST({v!r} AS FLOAT)"


def _hable(x: str) -> str:
    a, b, cc, d, e, f = map(_f, tone.HABLE)
    return f"(CAST(({x} * ({a} * {x} + {cc} * {b}) + {d} * {e}) / ({x} * ({a} * {x} + {b}) + {d} * {f}) AS FLOAT) - CAST({e} / {f} AS FLOAT))"


_A = [_f(v) for v in tone.ACES]
_SCALE = float(np.float32(1) / np.float32(np.log10(np.float32(26))))
_POWER = float(np.float32(np.log(np.float32(0.85))) / np.float32(np.log(np.float32(0.5))))
_LOG = "CAST(ln(CAST({} AS DOUBLE)) AS FLOAT)"
QUERIES["tone_curves"] = tone_curves, f"""WITH {i.HDR}, o AS (SELECT k, x AS linear, greatest(least(x, {_f(4.0)}), {_f(0.0)}) AS clamp, x / ({_f(1)} + x) AS reinhard,
 x * ({_f(1)} + x / ({_f(2.03)} * {_f(2.03)})) / ({_f(1)} + x) AS reinhard_extended, x * {_f(0.5)} AS exposure,
 greatest(least(x * ({_A[0]} * x + {_A[1]}) / (x * ({_A[2]} * x + {_A[3]}) + {_A[4]}), {_f(1.0)}), {_f(0.0)}) AS aces, {_hable('x')} / {_hable(_f(11.2))} AS hable,
 CAST({_f(_SCALE)} * {_LOG.format(f'x + {_f(1)}')} AS FLOAT)
  / {_LOG.format(f"{_f(2)} + CAST(pow(CAST(CAST(x / {_f(25)} AS FLOAT) AS DOUBLE), CAST({_f(_POWER)} AS DOUBLE)) AS FLOAT) * {_f(8)}")} AS drago FROM hdr)
SELECT k, {', '.join(f'round(CAST({name} AS DOUBLE), {DIGITS.get(name, 4)}) AS {name}' for name in CURVES)} FROM o"""
