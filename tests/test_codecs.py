import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelspark.operators import codecs as c


def blobs():
    rng = random.Random(7)
    out = [b"", b"\xab", b"\xab" * 1000, bytes(k % 256 for k in range(4096)), bytes((k * 2654435761 >> 24) & 255 for k in range(5000)), b"The quick brown fox jumps over the lazy dog. " * 50, b"\0" * 7000]
    return out + [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(1, 400))) for _ in range(40)]


def test_byte_round_trips():
    for raw in blobs():
        assert c.packbits_decode(c.packbits_encode(raw), len(raw)) == raw
        assert c.lzw_decode(c.lzw_encode(raw), len(raw)) == raw
        for level in ("store", "fast", "default", "best"):
            assert c.inflate(c.deflate(raw, level)) == raw and zlib.decompress(c.deflate(raw, level)) == raw
    assert len(c.packbits_encode(b"\xab" * 1000)) == 16 and c.packbits_encode(b"abc") == b"\x02abc"


@pytest.mark.parametrize("width", [1, 7, 8, 16, 33, 2600])
def test_bilevel_round_trips(width):
    rng = np.random.default_rng(width)
    for style in (rng.integers(0, 2, (9, width)), np.zeros((3, width), int), np.ones((3, width), int), np.cumsum(rng.random((9, width)) < 0.1, axis=1) % 2):
        raw = c.pack_rows(style, 1)
        assert (c.unpack_rows(raw, len(style), width, 1) == style).all()
        assert c.mh_decode(c.mh_encode(raw, width), len(style), width) == raw
        assert c.g4_decode(c.g4_encode(raw, width), len(style), width) == raw


@pytest.mark.parametrize("bits", [1, 2, 4, 8, 10, 12, 14, 16])
def test_sample_packing(bits):
    samples = np.random.default_rng(bits).integers(0, 1 << bits, (5, 13))
    raw = c.pack_rows(samples, bits)
    assert len(raw) == 5 * ((13 * bits + 7) // 8) and (c.unpack_rows(raw, 5, 13, bits) == samples).all()


@pytest.mark.parametrize("precision,parts", [(8, 1), (8, 3), (12, 1), (16, 2)])
def test_lossless_jpeg(precision, parts):
    samples = np.random.default_rng(parts).integers(0, 1 << precision, (7, 9, parts))
    samples[0, 0, 0], samples[0, 1, 0] = 0, (1 << precision) - 1
    assert (c.ljpeg_decode(c.ljpeg_encode(samples, precision)) == samples).all()
    flat = np.full((4, 4, parts), 5)
    assert (c.ljpeg_decode(c.ljpeg_encode(flat, precision)) == flat).all()


def test_malformed_input_raises_value_errors():
    rng = random.Random(1)
    good = [(c.packbits_decode, c.packbits_encode(b"aaaabcdef" * 5), (45,)), (c.lzw_decode, c.lzw_encode(b"abab" * 30), (120,)), (c.g4_decode, c.g4_encode(bytes(range(16)), 16), (8, 16)), (c.mh_decode, c.mh_encode(bytes(range(16)), 16), (8, 16)), (c.ljpeg_decode, c.ljpeg_encode(np.arange(16).reshape(4, 4, 1), 8), ())]
    for decode, raw, args in good:
        for cut in range(len(raw)):
            _tried(decode, raw[:cut], args)
        for _ in range(200):
            bad = bytearray(raw)
            bad[rng.randrange(len(bad))] ^= 1 << rng.randrange(8)
            _tried(decode, bytes(bad), args)


def _tried(decode, raw, args):
    try:
        decode(raw, *args)
    except ValueError:
        pass


def test_low_bits():
    w = c.LowBits()
    for value, size in ((5, 3), (0, 1), (300, 9), (1, 1), (0, 0)):
        w.put(value, size)
    r = c.LowBits(w.finish())
    assert [r.take(n) for n in (3, 1, 9, 1)] == [5, 0, 300, 1]
    with pytest.raises(ValueError):
        r.take(64)


def test_huffman_codes():
    counts = {k: 2**k for k in range(20)} | {99: 0}
    lengths = c.huffman_lengths(counts, 15)
    assert max(lengths.values()) <= 15 and c.kraft(lengths) == pytest.approx(1) and 99 not in lengths
    codes = c.canonical_codes(lengths)
    ordered = sorted(codes.values())
    assert not any(b.startswith(a) for a, b in zip(ordered, ordered[1:], strict=False))
    assert c.huffman_lengths({3: 9}, 15) == {3: 1} and c.huffman_lengths({}, 15) == {}


def test_columns_and_modes(spark):
    rows = spark.createDataFrame([(1, b"aaaabc"), (2, None), (3, b"")], "k int, raw binary")
    got = rows.select("k", c.codec("packbits", F.col("raw")).alias("p"), c.codec("packbits", F.col("raw"), 6, decode=True).alias("bad")).orderBy("k").collect()
    assert bytes(got[0].p) == c.packbits_encode(b"aaaabc") and got[1].p is None and got[0].bad is None
    with pytest.raises(Exception, match="PackBits"):
        rows.where("k = 1").select(c.codec("packbits", F.col("raw"), 6, decode=True, mode="failfast")).collect()
    with pytest.raises(ValueError):
        c.codec("nothing", F.col("raw"))
