import random

import numpy as np
import pytest

from pixelspark.operators import lossless as w


def images():
    rng = np.random.default_rng(1)
    x, y = np.meshgrid(np.arange(33), np.arange(21))
    smooth = np.stack([np.full_like(x, 255), (3 * x + y) % 256, (x + 2 * y) % 256, (x * y) % 256], axis=2)
    noise = rng.integers(0, 256, (13, 17, 4))
    few = np.array([[255, 1, 2, 3], [255, 9, 9, 9], [0, 0, 0, 0], [128, 255, 255, 255], [255, 0, 0, 255]])
    out = [smooth, noise, noise[:1], noise[:, :1], smooth.repeat(3, axis=0)]
    for n in (1, 2, 3, 5):
        out += [few[rng.integers(0, n, (9, 11))], few[rng.integers(0, n, (1, 1))]]
    out.append(np.concatenate([few[rng.integers(0, 5, 200)], np.repeat(few[:1], 9000, axis=0)]).reshape(92, 100, 4))
    out.append(rng.integers(0, 256, (16, 16, 1)).repeat(4, axis=2))
    return out


@pytest.mark.parametrize("colour", [False, True])
def test_round_trips(colour):
    for image in images():
        assert (w.decode(w.encode(image, colour=colour)) == image).all()
        assert (w.read_webp(w.write_webp(image, block_bits=2)) == image).all()


def test_transforms_invert():
    image = images()[0].astype(np.int64)
    assert (w.green_inverse(w.green_forward(image)) == image).all()
    for bits in (2, 3, 5):
        assert (w.predict_inverse(*w.predict_forward(image, bits), bits) == image).all()
        assert (w.colour_inverse(*w.colour_forward(image, bits), bits) == image).all()


def test_copies_make_flat_images_small():
    flat = np.full((200, 200, 4), 255)
    assert len(w.encode(flat)) < 60


def test_malformed_streams_raise():
    raw, rng = w.encode(images()[1]), random.Random(1)
    for cut in range(0, len(raw), 7):
        with pytest.raises(ValueError):
            w.decode(raw[:cut])
    for _ in range(60):
        bad = bytearray(raw)
        bad[rng.randrange(len(bad))] ^= 1 << rng.randrange(8)
        try:
            w.decode(bytes(bad))
        except ValueError:
            pass
    with pytest.raises(ValueError):
        w.encode(np.zeros((0, 3, 4)))


def test_alpha_planes():
    rng = np.random.default_rng(4)
    ramp = np.add.outer(np.arange(12), 3 * np.arange(19)) % 256
    for plane in (ramp, rng.integers(0, 256, (12, 19)), np.full((12, 19), 7), ramp[:1], ramp[:, :1], np.cumsum(rng.integers(0, 3, (12, 19)), axis=0)):
        assert (w.read_alpha(w.write_alpha(plane), *plane.shape) == plane).all()
        for kind in range(4):
            rest = ((plane - w._alpha_guess(plane.astype(np.int64), kind)) % 256).astype(np.uint8)
            assert (w.read_alpha(bytes([kind << 2]) + rest.tobytes(), *plane.shape) == plane).all()
    for bad in (b"", b"\0abc", b"\x02abc"):
        with pytest.raises(ValueError):
            w.read_alpha(bad, 12, 19)
