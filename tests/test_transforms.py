import math

import numpy as np
import pytest

from pixelspark.functions import transforms as t


def plain(kind, n):
    """The real matrix of the inverse: out = matrix @ coefficients."""
    size = 1 << n
    if kind == "dct":
        return np.array([[math.cos(math.pi * (2 * m + 1) * k / (2 * size)) * (math.sqrt(0.5) if k == 0 else 1) for k in range(size)] for m in range(size)])
    if n == 2:
        return np.array([[2 * math.sqrt(2) / 3 * math.sin(math.pi * (m + 1) * (2 * k + 1) / 9) for k in range(4)] for m in range(4)])
    return np.array([[math.sin(math.pi * (2 * m + 1) * (2 * k + 1) / (4 * size)) for k in range(size)] for m in range(size)])


KINDS = [("dct", n) for n in range(2, 7)] + [("adst", n) for n in (2, 3, 4)]


@pytest.mark.parametrize("kind,n", KINDS)
def test_inverse_is_near_the_real_transform(kind, n):
    values = np.random.default_rng(n).integers(-2000, 2000, (200, 1 << n))
    assert np.abs(t.inverse(values, kind, n) - values @ plain(kind, n).T).max() < 2 * n + 2


@pytest.mark.parametrize("kind,n", KINDS)
def test_forward_then_inverse(kind, n):
    values = np.random.default_rng(n).integers(-255, 256, (50, 1 << n))
    found = values @ t.forward_matrix(kind, n).T
    if kind == "dct":
        found[:, 0] = found[:, 0] * 2896 >> 12
    back = t.inverse((found + 2048) >> 12, kind, n)
    assert np.abs(back / (1 << (n - 1)) - values).max() < 4


@pytest.mark.parametrize("kind,n", [("dct", 2), ("dct", 4), ("dct", 5), ("adst", 2), ("adst", 3), ("adst", 4)])
def test_columns_match_arrays(spark, kind, n):
    names = [f"v{k:02d}" for k in range(1 << n)]
    values = np.random.default_rng(n).integers(-4000, 4000, (20, 1 << n))
    frame = spark.createDataFrame([(k, *map(int, x)) for k, x in enumerate(values)], "k int, " + ", ".join(f"{x} int" for x in names))
    found = t.inverse_columns(frame, names, kind, n, bits=14).orderBy("k").collect()
    assert [[r[x] for x in names] for r in found] == t.inverse(values, kind, n, bits=14).tolist()
    there = t.forward_columns(frame, names, kind, n).orderBy("k").collect()
    want = values @ t.forward_matrix(kind, n).T
    if kind == "dct":
        want[:, 0] = (want[:, 0] * 2896 + (1 << 23)) >> 24
        want[:, 1:] = (want[:, 1:] + 2048) >> 12
    else:
        want = (want + 2048) >> 12
    assert [[r[x] for x in names] for r in there] == want.tolist()
