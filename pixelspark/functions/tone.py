"""Tone curves as Column expressions in single precision, and a registry of them.

A curve is a function from Column to Column. Parameters are checked when the curve is made, before any job starts.
Single precision is kept by casting every literal and every power or logarithm back to FLOAT.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Curve = Callable[[Column], Column]

# SDR white, default white points and Drago's bias; the rational curves' coefficients.
SDR_WHITE, REINHARD_WHITE, HABLE_WHITE, DRAGO_BIAS, DRAGO_NITS = 1.0, 2.03, 11.2, 0.85, 100.0
ACES = (2.51, 0.03, 2.43, 0.59, 0.14)
HABLE = (0.15, 0.50, 0.10, 0.20, 0.02, 0.30)


def _f(value: float | np.float32) -> Column:
    return F.lit(float(value)).cast("float")


def _positive(name: str, value: float) -> np.float32:
    if not math.isfinite(value) or value <= 0:
        raise ValueError(f"{name} must be finite and greater than zero")
    return np.float32(value)


def _clamp(x: Column, low: float, high: float | np.float32) -> Column:
    return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, _f(low)), _f(high)))


def linear() -> Curve:
    return lambda x: x.cast("float")


def clamp(max_value: float = SDR_WHITE) -> Curve:
    high = _positive("max", max_value)
    return lambda x: _clamp(x.cast("float"), 0.0, high)


def reinhard() -> Curve:
    return lambda x: (x.cast("float") / (_f(1) + x.cast("float"))).cast("float")


def reinhard_extended(white: float = REINHARD_WHITE) -> Curve:
    square = _positive("white", white) ** 2

    def curve(x: Column) -> Column:
        x = x.cast("float")
        return ((x * (_f(1) + (x / _f(square)).cast("float"))).cast("float") / (_f(1) + x)).cast("float")

    return curve


def exposure(scale: float = 1.0, *, stops: float | None = None) -> Curve:
    factor = _positive("scale", 2.0**stops if stops is not None else scale)
    return lambda x: (x.cast("float") * _f(factor)).cast("float")


def aces() -> Curve:
    a, b, c, d, e = map(_f, ACES)

    def curve(x: Column) -> Column:
        x = x.cast("float")
        return _clamp(((x * (a * x + b)) / (x * (c * x + d) + e)).cast("float"), 0.0, 1.0)

    return curve


def _hable_part(x, constants, cast):  # noqa: ANN001, ANN202
    a, b, c, d, e, f = constants
    return cast(cast((x * (a * x + cast(c * b)) + cast(d * e)) / (x * (a * x + b) + cast(d * f))) - cast(e / f))


def hable(white: float = HABLE_WHITE) -> Curve:
    whole = _hable_part(_positive("white", white), [np.float32(v) for v in HABLE], np.float32)
    return lambda x: (_hable_part(x.cast("float"), [_f(v) for v in HABLE], lambda v: v.cast("float")) / _f(whole)).cast("float")


def drago(world_max: float, bias: float = DRAGO_BIAS) -> Curve:
    top = _positive("world_max", world_max)
    if not math.isfinite(bias) or not 0 < bias < 1:
        raise ValueError("bias must be between 0 and 1")
    exponent = np.float32(np.log(np.float32(bias))) / np.float32(np.log(np.float32(0.5)))
    scale = np.float32(DRAGO_NITS * 0.01) / np.float32(np.log10(top + np.float32(1)))

    def curve(x: Column) -> Column:
        x = x.cast("float")
        ratio = F.pow((x / _f(top)).cast("float"), _f(exponent)).cast("float")
        low = F.log((_f(2) + ratio * _f(8)).cast("float")).cast("float")
        return ((_f(scale) * F.log((x + _f(1)).cast("float")).cast("float")) / low).cast("float")

    return curve


_CURVES: dict[str, Callable[..., Curve]] = {
    "linear": linear, "clamp": clamp, "reinhard": reinhard, "reinhard_extended": reinhard_extended,
    "exposure": exposure, "aces": aces, "hable": hable, "drago": drago,
}


def register_curve(name: str, make: Callable[..., Curve]) -> None:
    """Adds a curve under a name; it replaces one of the same name."""
    _CURVES[name] = make


def tone_curve(name: str, **params: float) -> Curve:
    """The curve of that name with its parameters checked."""
    if name not in _CURVES:
        raise ValueError(f"no tone curve is called {name}")
    return _CURVES[name](**params)


def map_array(samples: Column, curve: Curve) -> Column:
    """The curve over every element of an array."""
    return F.transform(samples, curve)
