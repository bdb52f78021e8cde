"""Integer cosine and sine transforms of block codecs, as columns.

A transform is a list of stages, made by rule for each size; a stage is a set of operations on places of a vector that
don't touch each other: rotations by an angle in 128ths of a half turn, rounded to 12 bits, and sums and differences,
held to a range. In a DataFrame each stage is a projection of one column a place, so nothing is shuffled and no
expression is written twice; the same stages give SQL and work on numpy arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .integer import clip3, cos128, round2

#: (kind, first, second, angle, swapped): a rotation ("turn") or a sum and difference ("sum").
Step = tuple[str, int, int, int, bool]
#: 4096 times 2 sqrt(2) / 3 times the sine of 1 to 4 ninths of a half turn.
SINES = (1321, 2482, 3344, 3803)


def mirrored(bits: int, x: int) -> int:
    """The lowest bits of ``x`` in reverse."""
    return int(format(x, f"0{bits}b")[::-1], 2) if bits else 0


def _odd_half(n: int, at: int) -> list[list[Step]]:
    """The stages of the odd coefficients of 2^n, which stand from place ``at`` on: a rotation of each pair, then sums in
    growing groups, each followed by rotations of the places in a group's middle."""
    half = 1 << (n - 1)
    last, unit = at + half - 1, 1 << (6 - n)
    stages = [[("turn", at + i, last - i, 64 - unit - 4 * unit * mirrored(n - 2, i), False) for i in range(half // 2)]]
    for s in range(1, n - 1):
        size = 1 << s
        stages.append([("sum", *((a, b) if not g & 1 else (b, a)), 0, False) for g in range(half // size) for j in range(size // 2) for a, b in [(at + g * size + j, at + (g + 1) * size - 1 - j)]])
        turns: list[Step] = []
        for x in range(half // 2):
            quarter = x >> (s - 1) & 3
            if quarter in (1, 2):
                angle = 64 - unit * 2 ** (s + 1) - unit * 2 ** (s + 3) * mirrored(max(0, n - 3 - s), x >> (s + 1))
                turns.append(("turn", last - x, at + x, angle + 64 * (quarter == 2), True))
        stages.append(turns)
    return stages


def dct_stages(n: int) -> list[list[Step]]:
    """The inverse cosine transform of 2^n values (n from 1 to 6), which come in the mirrored order of their places."""
    if n == 1:
        return [[("turn", 0, 1, 32, True)]]
    half = 1 << (n - 1)
    even, odd = dct_stages(n - 1), _odd_half(n, half)
    both = [[*(even[k] if k < len(even) else []), *(odd[k] if k < len(odd) else [])] for k in range(max(len(even), len(odd)))]
    return [*both, [("sum", i, 2 * half - 1 - i, 0, False) for i in range(half)]]


def adst_stages(n: int) -> list[list[Step]]:
    """The inverse sine transform of 8 or 16 values."""
    size, unit = 1 << n, 1 << (5 - n)
    stages: list[list[Step]] = [[("turn", 2 * i, 2 * i + 1, 64 - unit - 4 * unit * i, True) for i in range(size // 2)]]
    part = size // 2
    while part >= 2:
        blocks = range(0, size, 2 * part)
        stages.append([("sum", b + i, b + part + i, 0, False) for b in blocks for i in range(part)])
        turns: list[Step] = []
        for b in blocks:
            for i in range(max(1, part // 4)):
                first, second = b + part + 2 * i, b + part + part // 2 + 2 * i
                turns.append(("turn", first, first + 1, 64 - 64 // part - 32 * i, True))
                if part > 2:
                    turns.append(("turn", second + 1, second, 64 // part + 32 * i, True))
        stages.append(turns)
        part //= 2
    return stages


def adst_order(n: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Where each place takes its value from before the stages, and after them, with its sign."""
    size = 1 << n
    before = [i - 1 if i & 1 else size - 1 - i for i in range(size)]
    after = [(mirrored(n, i ^ (i >> 1)), -1 if i & 1 else 1) for i in range(size)]
    return before, after


Apply = Callable[[list, list[list[Step]]], list]


def _transform(values: list, kind: str, n: int, apply: Apply, small: Callable[[list], list]) -> list:
    if kind == "dct":
        if not 2 <= n <= 6:
            raise ValueError("n must be from 2 to 6")
        return apply([values[mirrored(n, i)] for i in range(1 << n)], dct_stages(n))
    if kind != "adst" or not 2 <= n <= 4:
        raise ValueError("a sine transform has n from 2 to 4")
    if n == 2:
        return small(values)
    before, after = adst_order(n)
    found = apply([values[k] for k in before], adst_stages(n))
    return [found[k] * sign for k, sign in after]


def _sines(v: Sequence, rounded: Callable) -> list:
    """The inverse sine transform of four values."""
    a, b, c, d = SINES
    x, y, z = a * v[0] + d * v[2] + b * v[3], b * v[0] - a * v[2] - d * v[3], c * v[1]
    return [rounded(t) for t in (x + z, y + z, c * (v[0] - v[2] + v[3]), x + y - z)]


def inverse(values: np.ndarray, kind: str, n: int, bits: int = 32) -> np.ndarray:
    """The inverse transform of rows of 2^n integers; sums are held to ``bits`` bits."""
    top = 1 << (bits - 1)
    rounded = lambda x: (x + 2048) >> 12

    def apply(v: list, stages: list[list[Step]]) -> list:
        for stage in stages:
            for what, a, b, angle, swapped in stage:
                if what == "sum":
                    v[a], v[b] = np.clip(v[a] + v[b], -top, top - 1), np.clip(v[a] - v[b], -top, top - 1)
                else:
                    cos, sin = cos128(angle), cos128(angle - 64)
                    x, y = rounded(v[a] * cos - v[b] * sin), rounded(v[a] * sin + v[b] * cos)
                    v[a], v[b] = (y, x) if swapped else (x, y)
        return v

    columns = [np.asarray(values, np.int64)[:, k].copy() for k in range(1 << n)]
    return np.stack(_transform(columns, kind, n, apply, lambda v: _sines(v, rounded)), axis=1)


def inverse_columns(df: DataFrame, names: Sequence[str], kind: str, n: int, bits: int = 32) -> DataFrame:
    """``df`` with the columns ``names`` (2^n of them) replaced by their inverse transform."""
    top = 1 << (bits - 1)
    frame = df.withColumns({x: F.col(x).cast("long") for x in names})
    where: dict[int, Column] = {}

    def apply(v: list, stages: list[list[Step]]) -> list:
        nonlocal frame
        frame = frame.withColumns(dict(zip(names, v, strict=True)))
        for stage in stages:
            new: dict[str, Column] = {}
            for what, a, b, angle, swapped in stage:
                x, y = F.col(names[a]), F.col(names[b])
                if what == "sum":
                    new |= {names[a]: clip3(-top, top - 1, x + y), names[b]: clip3(-top, top - 1, x - y)}
                else:
                    cos, sin = cos128(angle), cos128(angle - 64)
                    one, two = round2(x * cos - y * sin, 12), round2(x * sin + y * cos, 12)
                    new |= {names[a]: two if swapped else one, names[b]: one if swapped else two}
            frame = frame.withColumns(new)
        return [F.col(x) for x in names]

    out = _transform([F.col(x) for x in names], kind, n, apply, lambda v: _sines(v, lambda x: round2(x, 12)))
    where = dict(enumerate(out))
    return frame.withColumns({x: where[k] for k, x in enumerate(names)})


def inverse_sql(source: str, keys: str, names: Sequence[str], kind: str, n: int, bits: int = 32) -> str:
    """The same as a query over ``source``, a table expression that has ``keys`` and ``names``."""
    top, steps = 1 << (bits - 1), []

    def projected(new: dict[str, str]) -> None:
        last = f"st{len(steps) - 1}" if steps else source
        steps.append(f"st{len(steps)} AS (SELECT {keys}, {', '.join(f'{new[x]} AS {x}' if x in new else x for x in names)} FROM {last})")

    class Text(str):
        def __mul__(self, sign: int) -> Text:
            return self if sign == 1 else Text(f"-({self})")

    def apply(v: list, stages: list[list[Step]]) -> list:
        projected(dict(zip(names, v, strict=True)))
        for stage in stages:
            new: dict[str, str] = {}
            for what, a, b, angle, swapped in stage:
                x, y = names[a], names[b]
                if what == "sum":
                    new |= {x: f"greatest(least({x} + {y}, {top - 1}), {-top})", y: f"greatest(least({x} - {y}, {top - 1}), {-top})"}
                else:
                    cos, sin = cos128(angle), cos128(angle - 64)
                    one, two = f"({x} * ({cos}) - {y} * ({sin}) + 2048) >> 12", f"({x} * ({sin}) + {y} * ({cos}) + 2048) >> 12"
                    new |= {x: two if swapped else one, y: one if swapped else two}
            projected(new)
        return [Text(x) for x in names]

    def small(v: list) -> list:
        a, b, c, d = SINES
        x, y, z = f"({a} * {v[0]} + {d} * {v[2]} + {b} * {v[3]})", f"({b} * {v[0]} - {a} * {v[2]} - {d} * {v[3]})", f"{c} * {v[1]}"
        return [f"({t} + 2048) >> 12" for t in (f"{x} + {z}", f"{y} + {z}", f"{c} * ({v[0]} - {v[2]} + {v[3]})", f"{x} + {y} - {z}")]

    out = _transform(list(names), kind, n, apply, small)
    projected(dict(zip(names, map(str, out), strict=True)))
    return f"WITH {', '.join(steps)} SELECT {keys}, {', '.join(names)} FROM st{len(steps) - 1}"


def forward_matrix(kind: str, n: int) -> np.ndarray:
    """(2^n, 2^n) integers, 4096 times the transform whose inverse is the above: the cosines' own, or the transposed
    answers of the inverse sine transform to 4096 at each place."""
    if kind == "adst":
        return inverse(np.eye(1 << n, dtype=np.int64) * 4096, kind, n)
    size, step = 1 << n, 64 >> n
    return np.array([[cos128(step * (2 * m + 1) * k) for m in range(size)] for k in range(size)])


#: From so many places on, sums of products written out are more code than a compiled method or the compiler's memory
#: holds, and the matrix is one literal instead.
WRITTEN_OUT = 32


def forward_columns(df: DataFrame, names: Sequence[str], kind: str, n: int) -> DataFrame:
    """``df`` with the columns ``names`` replaced by their forward transform; each is one sum of products."""
    matrix = forward_matrix(kind, n)
    frame = df.withColumns({x: F.col(x).cast("long") for x in names})
    others = [F.col(f"`{x}`") for x in df.columns if x not in names]
    rounded = lambda k, out: round2(out * 2896, 24) if kind == "dct" and k == 0 else round2(out, 12)
    if len(names) < WRITTEN_OUT:
        total = lambda k: sum((F.col(x) * int(w) for x, w in zip(names, matrix[k], strict=True)), F.lit(0).cast("long"))
        return frame.select(*others, *[rounded(k, total(k)).alias(x) for k, x in enumerate(names)])
    rows = F.expr(f"array({', '.join(f'array({", ".join(f"{int(w)}L" for w in row)})' for row in matrix)})")
    product = lambda row: F.aggregate(F.zip_with("__values", row, lambda v, w: v * w), F.lit(0).cast("long"), lambda s, x: s + x)
    sums = frame.select(*others, F.array(*[F.col(x) for x in names]).alias("__values")).select(*others, F.transform(rows, product).alias("__sums"))
    return sums.select(*others, *[rounded(k, F.element_at("__sums", k + 1)).alias(x) for k, x in enumerate(names)])


def flipped(names: Sequence[str]) -> list[Column]:
    """The values of the columns in reverse, under the same names: a flipped sine transform is one of these."""
    return [F.col(x).alias(y) for x, y in zip(reversed(names), names, strict=True)]


def quantise(coefficient: Column, step: Column) -> Column:
    """The coded level of a coefficient: the nearest multiple, halves away from zero."""
    size = F.floor((F.abs(coefficient) + F.floor(step / 2)) / step)
    return F.when(coefficient < 0, -size).otherwise(size).cast("long")


def identity_planes(pixels: DataFrame) -> DataFrame:
    """Planes y, u, v of pixels r, g, b under identity coefficients: green, blue, red; other columns stay."""
    return pixels.withColumnsRenamed({"g": "y_plane", "b": "u_plane", "r": "v_plane"})


def identity_pixels(planes: DataFrame) -> DataFrame:
    return planes.withColumnsRenamed({"y_plane": "g", "u_plane": "b", "v_plane": "r"})
