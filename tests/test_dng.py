import random

import numpy as np
import pytest

from pixelspark.sources import dng, tiff


@pytest.mark.parametrize("bits", [8, 10, 12, 14, 16])
@pytest.mark.parametrize("compression", ["none", "deflate", "ljpeg"])
def test_round_trips(bits, compression):
    x, y = np.meshgrid(np.arange(13), np.arange(9))
    mosaic = ((53 * x ^ 97 * y) % ((1 << bits) - 1))[:, :, None]
    linear = np.stack([(7 * x ^ 13 * y ^ 101 * c) % ((1 << bits) - 1) for c in range(3)], axis=2)
    for raw in (dng.Raw(mosaic, bits, black=5, model="unit"), dng.Raw(linear, bits, repeat=None, pattern=())):
        for big, endian in ((False, False), (True, True)):
            data = dng.write(raw, compression=compression, big=big, big_endian=endian)
            back = dng.read(data)
            assert (back.samples == raw.samples).all() and (back.bits, back.black, back.white, back.repeat, back.model) == (raw.bits, raw.black, raw.white, raw.repeat, raw.model)
            assert back.color_matrix1 == pytest.approx(raw.color_matrix1) and back.illuminant1 == 21
            assert (tiff.read_page(data) == raw.preview()).all()
            assert [p for p, _ in tiff.Reader(data).directories()] == ["0", "0/0/0"]


def test_preview_of_a_tile():
    mosaic = np.tile(np.array([[200, 100], [100, 50]]), (2, 2))[:, :, None]
    assert (dng.Raw(mosaic, 8).preview() == np.array([200, 100, 50])).all()
    linear = np.zeros((2, 2, 3), int)
    linear[0, :, 0], linear[1, :, 1] = (100, 200), (60, 100)
    assert dng.Raw(linear, 8, repeat=None, pattern=()).preview().tolist() == [[[75, 40, 0]]]


def test_refusals_and_damage(spark):
    with pytest.raises(ValueError):
        dng.Raw(np.zeros((2, 2, 1), int), 17)
    with pytest.raises(ValueError):
        dng.Raw(np.zeros((2, 2, 3), int), 8)
    with pytest.raises(ValueError):
        dng.read(tiff.write_pages([np.zeros((2, 2, 3), np.uint8)]))
    good, rng = dng.write(dng.Raw(np.arange(64).reshape(8, 8, 1), 12), compression="ljpeg"), random.Random(2)
    for _ in range(300):
        bad = bytearray(good)
        bad[rng.randrange(len(bad))] ^= 1 << rng.randrange(8)
        try:
            dng.read(bytes(bad[: rng.randint(0, len(bad))]) if rng.random() < 0.3 else bytes(bad))
        except ValueError:
            pass
    rows = spark.createDataFrame([("a", good), ("b", b"no"), ("c", None)], "path string, content binary")
    found = {r.path: r for r in dng.read_raws(rows).collect()}
    assert found["a"].width == 8 and len(found["a"].samples) == 128 and found["b"].error and found["c"].error
