import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelspark.functions import color, integer, tone


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_transfer_curves_at_their_knees(spark):
    x = lambda v: F.lit(float(v))
    row = one(spark, color.srgb_eotf(x(0.04045)), color.srgb_eotf(x(1)), color.srgb_oetf(x(0.0031308)), color.pq_eotf(x(1)), color.pq_eotf(x(0)), color.prophoto_rgb_eotf(x(0.01), standard=True), color.eotf_for(F.lit(1), x(0.5)), color.bt2020_pq_to_sdr(x(1)))
    assert row[0] == pytest.approx(0.04045 / 12.92) and row[1] == pytest.approx(1) and row[2] == pytest.approx(0.0031308 * 12.92)
    assert row[3] == pytest.approx(10000) and row[4] == pytest.approx(0) and row[5] == pytest.approx(0.01 / 16) and row[6] is None
    assert row[7] == pytest.approx(10000 / 10203)


def test_oklab_white_and_back(spark):
    lit = [F.lit(v) for v in (1.0, 1.0, 1.0)]
    lab = one(spark, *color.linear_rgb_to_oklab(lit))
    assert lab[0] == pytest.approx(1, abs=1e-6) and abs(lab[1]) < 1e-6 and abs(lab[2]) < 1e-6
    rgb = one(spark, *color.oklab_to_linear_srgb(color.linear_rgb_to_oklab([F.lit(v) for v in (0.2, 0.5, 0.9)])))
    assert list(rgb) == pytest.approx([0.2, 0.5, 0.9], abs=1e-5)
    assert one(spark, *color.linear_rgb_to_oklab(lit, F.lit("unknown"))) == (None, None, None)


def test_matrices_are_those_of_the_primaries():
    for space in color.SPACES:
        assert np.allclose(color.derive_m1(space), color.M1[space], atol=1e-6)
    assert color.inverse([[1, 2, 3], [2, 4, 6], [1, 1, 1]]) is None
    m = [[2.0, 1, 0], [0, 3, 1], [1, 0, 1]]
    assert np.allclose(color.product(m, color.inverse(m)), np.eye(3))


def test_soft_clamp_ends_in_space(spark):
    rows = spark.createDataFrame([(0.7, 0.3, 0.1), (0.5, 0.0, 0.0), (1.2, 0.0, 0.0)], "l double, a double, b double")
    out = color.soft_clamp(rows, ("l", "a", "b"), 1.0)
    back = out.select(*color.oklab_to_linear_srgb([F.col(x) for x in "lab"])).collect()
    assert all(-1e-9 <= v <= 1 + 1e-9 for r in back for v in r)
    assert out.collect()[1] == (0.5, 0.0, 0.0)


def test_ycbcr_round_trip_is_near(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([tuple(rng.randrange(256) for _ in range(3)) for _ in range(500)], "r int, g int, b int")
    for kind in ("full", "limited"):
        back = rows.select("r", "g", "b", *color.ycbcr_to_rgb(color.rgb_to_ycbcr([F.col(c) for c in "rgb"], kind), kind)).collect()
        assert all(abs(a - b) <= 3 for row in back for a, b in zip(row[:3], row[3:], strict=True))


def test_tone_curve_golden_values(spark):
    x = lambda v: F.lit(v).cast("float")
    row = one(spark, tone.tone_curve("aces")(x(0.5)), tone.tone_curve("hable")(x(1.0)), tone.tone_curve("drago", world_max=100.0)(x(10.0)), tone.tone_curve("exposure", stops=2.0)(x(1.5)), tone.tone_curve("clamp", max_value=2.0)(x(float("nan"))))
    assert list(row[:4]) == pytest.approx([0.616307, 0.3043, 0.630858, 6.0], rel=1e-4) and math.isnan(row[4])
    for bad in (0.0, -1.0, float("inf"), float("nan")):
        with pytest.raises(ValueError):
            tone.tone_curve("reinhard_extended", white=bad)
    with pytest.raises(ValueError):
        tone.tone_curve("drago", world_max=1.0, bias=1.0)
    with pytest.raises(ValueError):
        tone.tone_curve("none of these")
    tone.register_curve("half", lambda: lambda c: c / 2)
    assert one(spark, tone.map_array(F.array(F.lit(2.0), F.lit(4.0)), tone.tone_curve("half")))[0] == [1.0, 2.0]


def test_integer_functions_against_python(spark):
    rng = random.Random(2)
    rows = [(rng.randint(-70000, 70000), rng.randint(1, 500)) for _ in range(300)] + [(0, 1), (-1, 2), (5, 2), (-5, 2)]
    s, d = F.col("s"), F.col("d")
    got = spark.createDataFrame(rows, "s long, d long").select("s", "d", integer.round2(s, 4), integer.round_div_nearest(s, d), integer.wrap8(s), integer.signed8(s), integer.signed16(s), integer.leb128_len(F.abs(s)), integer.leb128(F.abs(s)), integer.reverse_bits(F.abs(s) % 1024, 10)).collect()
    from pixelspark.operators.codecs import leb128

    for r in got:
        half = lambda v, k: int(math.copysign((abs(v) + k // 2) // k, v)) if v else 0
        assert list(r[2:7]) == [(r.s + 8) >> 4, half(r.s, r.d), r.s % 256, (r.s + 128) % 256 - 128, (r.s + 32768) % 65536 - 32768]
        assert r[7] == len(leb128(abs(r.s))) and bytes(r[8]) == leb128(abs(r.s))
        assert r[9] == int(format(abs(r.s) % 1024, "010b")[::-1], 2)


def test_transforms_invert(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([([rng.randint(-255, 255) for _ in range(16)],) for _ in range(50)], "v array<int>")
    back = rows.select(integer.iwht4x4(integer.fwht4x4(F.col("v"))).alias("b"), F.col("v").cast("array<long>").alias("v"))
    assert back.where("b <> v").isEmpty()
    flat = one(spark, integer.forward_dct(F.array(*[F.lit(16)] * 16), 4))[0]
    assert flat[1:] == [0] * 15 and flat[0] > 0
    with pytest.raises(ValueError):
        integer.forward_dct(F.col("v"), 7)


def test_mulaw(spark):
    x = [k / 50 for k in range(-50, 51)] + [2.0, -3.0]
    rows = spark.createDataFrame([(v,) for v in x], "v double")
    q = integer.mu_quantize(F.col("v"), 8, 255.0)
    for r in rows.select("v", q.alias("q"), integer.mu_dequantize(q, 8, 255.0).alias("b")).collect():
        assert 0 <= r.q <= 254 and abs(r.b - max(-1, min(1, r.v))) < 0.03
    with pytest.raises(ValueError):
        integer.mu_quantize(F.col("v"), 1, 255.0)


def test_code_tables_cover_their_ranges(spark):
    lengths = spark.range(3, 259).select("id", integer.deflate_code(F.col("id"), "length").alias("c")).collect()
    assert all(dict((s, b) for s, _, b in integer.deflate_bases("length"))[r.c.symbol] + r.c.extra == r.id for r in lengths)
    assert lengths[-1].c == (285, 0, 0) and integer.deflate_bases("distance")[-1] == (29, 13, 24577)
    for r in spark.range(1, 3000).select("id", integer.value_to_prefix(F.col("id")).alias("c")).collect():
        prefix, bits, extra = r.c
        value = prefix + 1 if prefix < 4 else ((2 + prefix % 2) << (prefix // 2 - 1)) + extra + 1
        assert value == r.id and extra < 1 << bits if bits else value == r.id
    assert integer.zlib_header("default") == b"\x78\x9c" and integer.zlib_header("best") == b"\x78\xda" and integer.zlib_header("store") == b"\x78\x01"
