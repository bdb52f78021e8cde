"""Colour science as Column expressions: transfer curves, OKLab, space mapping, matrices and YCbCr.

A colour is three Columns. Everything here stays inside whole-stage codegen, but for the
sixteen bisection steps of ``soft_clamp``, which are an Arrow function.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]
Matrix = Sequence[Sequence[float]]

# OKLab matrices (linear RGB of each space to LMS, cube-rooted LMS to Lab, and their inverses).
M2 = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
M2_INV = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480))
M1 = {
    "srgb": ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005)),
    "display_p3": ((0.4813798544, 0.4621183697, 0.0565017758), (0.2288319449, 0.6532168128, 0.1179512422), (0.0839457557, 0.2241652689, 0.6918889754)),
    "adobe_rgb": ((0.5764322615, 0.3699132211, 0.0536545174), (0.2963164739, 0.5916761266, 0.1120073994), (0.1234782548, 0.2194986958, 0.6570230494)),
    "bt2020": ((0.6167557872, 0.3601983994, 0.0230458134), (0.2651330640, 0.6358393641, 0.0990275718), (0.1001026342, 0.2039065194, 0.6959908464)),
    "prophoto_rgb": ((0.7154484635, 0.3527915480, -0.0682400115), (0.2744116551, 0.6677976408, 0.0577907040), (0.1097844385, 0.1861982875, 0.7040172740)),
}
M1_INV_SRGB = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))
# White points, primaries and the Bradford matrix.
D65, D50 = (0.3127, 0.3290), (0.3457, 0.3585)
BRADFORD = ((0.8951, 0.2664, -0.1614), (-0.7502, 1.7135, 0.0367), (0.0389, -0.0685, 1.0296))
PRIMARIES = {
    "srgb": (((0.6400, 0.3300), (0.3000, 0.6000), (0.1500, 0.0600)), D65),
    "display_p3": (((0.6800, 0.3200), (0.2650, 0.6900), (0.1500, 0.0600)), D65),
    "adobe_rgb": (((0.6400, 0.3300), (0.2100, 0.7100), (0.1500, 0.0600)), D65),
    "bt2020": (((0.7080, 0.2920), (0.1700, 0.7970), (0.1310, 0.0460)), D65),
    "prophoto_rgb": (((0.734699, 0.265301), (0.159597, 0.840403), (0.036598, 0.000105)), D50),
}
SPACES = tuple(M1)
HDR_WHITE_NITS, PQ_PEAK_NITS = 203.0, 10000.0
CLAMP_STEPS = 16


def srgb_eotf(x: Column) -> Column:
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, 2.4))


def srgb_oetf(x: Column) -> Column:
    return F.when(x <= 0.0031308, x * 12.92).otherwise(F.pow(x, 1.0 / 2.4) * 1.055 - 0.055)


def adobe_rgb_eotf(x: Column, standard: bool = False) -> Column:
    return F.pow(x, 563.0 / 256.0 if standard else 2.2)


def prophoto_rgb_eotf(x: Column, standard: bool = False) -> Column:
    curve = F.pow(x, 1.8)
    return F.when(x < 1.0 / 32.0, x / 16.0).otherwise(curve) if standard else curve


def pq_eotf(x: Column) -> Column:
    """ST 2084, in nits."""
    n = F.pow(x, 1.0 / 78.84375)
    return F.pow(F.greatest(n - 0.8359375, F.lit(0.0)) / (18.8515625 - n * 18.6875), 1.0 / 0.1593017578125) * PQ_PEAK_NITS


def bt2020_pq_to_sdr(x: Column) -> Column:
    light = pq_eotf(x) / HDR_WHITE_NITS
    return light / (light + 1.0)


def eotf_for(code: Column, x: Column) -> Column:
    """The curve of a CICP transfer code: 13 is sRGB, 14 and 16 are PQ to SDR; null for any other."""
    return F.when(code == 13, srgb_eotf(x)).when(code.isin(14, 16), bt2020_pq_to_sdr(x))


def apply3(m: Matrix, v: Sequence[Column]) -> Vector:
    return tuple(v[0] * row[0] + v[1] * row[1] + v[2] * row[2] for row in m)  # type: ignore[return-value]


def _by_space(space: Column | str, value: Callable[[str], Column]) -> Column:
    if isinstance(space, str):
        return value(space)
    out = None
    for name in SPACES:
        out = F.when(space == name, value(name)) if out is None else out.when(space == name, value(name))
    return out


def linear_rgb_to_oklab(rgb: Sequence[Column], space: Column | str = "srgb") -> Vector:
    """Null for an unknown space."""
    lms = [F.cbrt(_by_space(space, lambda name, k=k: apply3(M1[name], rgb)[k])) for k in range(3)]
    return apply3(M2, lms)


def oklab_to_linear_srgb(lab: Sequence[Column]) -> Vector:
    return apply3(M1_INV_SRGB, [x * x * x for x in apply3(M2_INV, lab)])


def in_space(rgb: Sequence[Column]) -> Column:
    return rgb[0].between(0.0, 1.0) & rgb[1].between(0.0, 1.0) & rgb[2].between(0.0, 1.0)


def _clamped(blend: float) -> Callable[[pd.Series, pd.Series, pd.Series], pd.DataFrame]:
    def run(l: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        lab = [x.to_numpy(np.float64, copy=True, na_value=np.nan) for x in (l, a, b)]

        def inside(x: Sequence[np.ndarray]) -> np.ndarray:
            rgb = apply3(M1_INV_SRGB, [c * c * c for c in apply3(M2_INV, x)])
            return np.logical_and.reduce([(c >= 0.0) & (c <= 1.0) for c in rgb])

        with np.errstate(all="ignore"):
            out = np.flatnonzero(~inside(lab))
            l, a, b = (x[out] for x in lab)
            at = lambda t: (l + (0.5 - l) * blend * t, a * (1.0 - t), b * (1.0 - t))
            lo, hi = np.zeros(len(out)), np.ones(len(out))
            for _ in range(CLAMP_STEPS):
                mid = (lo + hi) / 2.0
                ok = inside(at(mid))
                lo, hi = np.where(ok, lo, mid), np.where(ok, mid, hi)
            for x, y in zip(lab, at(hi), strict=True):
                x[out] = y
        return pd.DataFrame(dict(zip("lab", lab, strict=True)))

    return run


def soft_clamp(df: DataFrame, lab: Sequence[str], blend: float, out: Sequence[str] = ("l", "a", "b")) -> DataFrame:
    """``df`` with columns ``out``: the OKLab colour of columns ``lab`` itself if sRGB holds it, else what sixteen
    bisection steps toward grey give. The steps are an Arrow function, over the colours outside alone: as Columns they
    are one method, too large for the JVM to compile to machine code. A null stays null."""
    clamp = F.pandas_udf(_clamped(blend), "l double, a double, b double")
    found = df.withColumn("__clamped", clamp(*[F.col(x) for x in lab]))
    # pandas gives NaN back as null.
    kept = {o: F.when(F.col(x).isNotNull(), F.coalesce(F.col("__clamped")[k], F.lit(float("nan")))) for o, x, k in zip(out, lab, "lab", strict=True)}
    return found.withColumns(kept).drop("__clamped")


# 3 x 3 algebra on the driver: matrices are literals of a plan.


def product(a: Matrix, b: Matrix) -> list[list[float]]:
    return [[sum(a[i][k] * b[k][j] for k in range(3)) for j in range(3)] for i in range(3)]


def inverse(m: Matrix) -> list[list[float]] | None:
    """By cofactors; None without a finite, non-zero determinant."""
    minor = [[m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3] for j in range(3)] for i in range(3)]
    det = sum(m[0][j] * minor[0][j] for j in range(3))
    if det == 0 or det != det or abs(det) == float("inf"):
        return None
    return [[minor[j][i] / det for j in range(3)] for i in range(3)]


def xy_to_xyz(x: float, y: float) -> list[float]:
    return [x / y, 1.0, (1.0 - x - y) / y]


def _times(m: Matrix, v: Sequence[float]) -> list[float]:
    return [sum(row[k] * v[k] for k in range(3)) for row in m]


def rgb_to_xyz_matrix(primaries: Sequence[tuple[float, float]], white: tuple[float, float]) -> list[list[float]] | None:
    columns = [xy_to_xyz(*p) for p in primaries]
    m = [[columns[j][i] for j in range(3)] for i in range(3)]
    back = inverse(m)
    if back is None:
        return None
    scale = _times(back, xy_to_xyz(*white))
    return [[m[i][j] * scale[j] for j in range(3)] for i in range(3)]


def bradford_adapt(source: tuple[float, float], target: tuple[float, float]) -> list[list[float]]:
    a, b = _times(BRADFORD, xy_to_xyz(*source)), _times(BRADFORD, xy_to_xyz(*target))
    scale = [[b[i] / a[i] if i == j else 0.0 for j in range(3)] for i in range(3)]
    return product(inverse(BRADFORD), product(scale, BRADFORD))


def derive_m1(space: str) -> list[list[float]]:
    """A space's matrix to LMS from its primaries, by way of sRGB's."""
    to_lms = product(M1["srgb"], inverse(rgb_to_xyz_matrix(*PRIMARIES["srgb"])))
    primaries, white = PRIMARIES[space]
    xyz = rgb_to_xyz_matrix(primaries, white)
    return product(to_lms, xyz if white == D65 else product(bradford_adapt(white, D65), xyz))


# Source profiles: space, transfer, CICP primaries and transfer (None where CICP has none), tone mapping.
PROFILES = (
    ("srgb", "srgb", "srgb", 1, 13, None),
    ("display_p3", "display_p3", "srgb", 12, 13, None),
    ("adobe_rgb", "adobe_rgb", "adobe_rgb", None, None, None),
    ("bt2020", "bt2020", "bt2020_pq", 9, 16, HDR_WHITE_NITS),
    ("prophoto_rgb", "prophoto_rgb", "prophoto_rgb", None, None, None),
)


def profile_eotf(transfer: Column, x: Column) -> Column:
    return F.when(transfer == "srgb", srgb_eotf(x)).when(transfer == "adobe_rgb", adobe_rgb_eotf(x)).when(transfer == "prophoto_rgb", prophoto_rgb_eotf(x)).when(transfer == "bt2020_pq", bt2020_pq_to_sdr(x))


def clip8(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(255)), F.lit(0)).cast("int")


def clip_pixel(x: Column, bits: int) -> Column:
    return F.greatest(F.least(x, F.lit((1 << bits) - 1)), F.lit(0)).cast("int")


# 16-bit fixed-point BT.601 coefficients, full and limited range.
_FORWARD = {
    "full": ((19595, 38470, 7471, 32768), (-11059, -21709, 32768, 8421376), (32768, -27439, -5329, 8421376)),
    "limited": ((16839, 33059, 6420, 1081344), (-9719, -19081, 28800, 8421376), (28800, -24116, -4684, 8421376)),
}


def rgb_to_ycbcr(rgb: Sequence[Column], range_: str = "full") -> Vector:
    r, g, b = (x.cast("long") for x in rgb)
    return tuple(clip8(F.shiftright(r * p + g * q + b * s + bias, 16)) for p, q, s, bias in _FORWARD[range_])  # type: ignore[return-value]


def ycbcr_to_rgb(ycc: Sequence[Column], range_: str = "full") -> Vector:
    y, cb, cr = (x.cast("long") for x in ycc)
    if range_ == "full":
        cb, cr = cb - 128, cr - 128
        return (clip8(y + F.shiftright(cr * 91881 + 32768, 16)), clip8(y + F.shiftright(cb * -22554 - cr * 46802 + 32768, 16)), clip8(y + F.shiftright(cb * 116130 + 32768, 16)))

    def high(v: Column, k: int) -> Column:
        return F.shiftright(v * k, 8)

    def clip(v: Column) -> Column:
        return clip8(F.shiftright(v, 6))

    luma = high(y, 19077)
    return clip(luma + high(cr, 26149) - 14234), clip(luma - high(cb, 6419) - high(cr, 13320) + 8708), clip(luma + high(cb, 33050) - 17685)
