import random

import pytest

from pixelspark.operators import coders as c


@pytest.mark.parametrize("seed", range(5))
def test_bool_coder(seed):
    rng = random.Random(seed)
    flags = [(rng.random() * 256 >= (p := rng.randint(1, 255)), p) for _ in range(3000)]
    writer = c.BoolWriter()
    for flag, prob in flags:
        writer.put(flag, prob)
    writer.literal(0b1011, 4)
    raw = writer.finish()
    reader = c.BoolReader(raw)
    assert [reader.get(p) for _, p in flags] == [f for f, _ in flags] and reader.literal(4) == 0b1011
    assert not reader.past_end and len(raw) < 3000 / 8
    empty = c.BoolReader(b"")
    for _ in range(20):
        empty.get()
    assert empty.past_end


def test_bool_carries():
    writer = c.BoolWriter()
    flags = [True] * 400 + [False] * 3 + [True] * 200
    for flag in flags:
        writer.put(flag, 255)
    reader = c.BoolReader(writer.finish())
    assert [reader.get(255) for _ in flags] == flags


def test_trees():
    tree = [-0, 2, -1, 4, -2, -3]
    paths, probs = c.tree_paths(tree), [100, 50, 200]
    assert set(paths) == {0, 1, 2, 3} and paths[3] == [(0, True), (1, True), (2, True)]
    writer = c.BoolWriter()
    for leaf in (3, 0, 2, 1):
        writer.tree(paths[leaf], probs)
    reader = c.BoolReader(writer.finish())
    for leaf in (3, 0, 2, 1):
        assert [(k, reader.get(probs[k])) for k, _ in paths[leaf]] == paths[leaf]


@pytest.mark.parametrize("symbols", [2, 3, 8, 16])
def test_range_coder(symbols):
    rng = random.Random(symbols)
    cdf = sorted(rng.sample(range(64, 32700), symbols - 1)) + [32768]
    text = [rng.choice([0, rng.randrange(symbols)]) for _ in range(2000)]
    writer = c.SymbolWriter()
    for s in text:
        writer.put(s, cdf)
    writer.literal(12345, 20)
    reader = c.SymbolReader(writer.finish())
    assert [reader.get(cdf) for _ in text] == text and reader.literal(20) == 12345


def test_adaptive_bytes():
    rng = random.Random(9)
    for raw in (b"", b"a", bytes(1000), bytes(rng.randrange(256) for _ in range(500)), b"the same words and the same words " * 40):
        assert c.decode_bytes(c.encode_bytes(raw), len(raw)) == raw
    assert len(c.encode_bytes(bytes(1000))) < 60
    cdf, count = c._flat(4), 0
    for _ in range(100):
        count = c.adapt(cdf, 2, count)
    assert count == 32 and cdf[1] < 6000 and cdf[2] > 27000 and cdf[3] == 32768
