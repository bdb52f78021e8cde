import itertools
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from pixelspark.llm import buckets
from pixelspark.llm import components as c
from pixelspark.llm import simhash as s


def fingerprint(text, words):
    tokens = (text or "").encode().lower().split()
    shingles = [b" ".join(tokens[k : k + words]) for k in range(max(1, len(tokens) - words + 1))] if tokens else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64)) if hashes else 0


def classes(nodes, linked):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_the_code_is_perfect_and_decodes():
    upper, errors = s._golay()
    assert (errors >= 0).all()
    rng = np.random.default_rng(0)
    values = rng.integers(0, 1 << 23, 1000)
    words = values ^ errors[upper[values >> 11] ^ (values & 2047)]
    assert (np.bitwise_count(words ^ values) <= 3).all() and (upper[words >> 11] == (words & 2047)).all()


def test_fuzzy_sets_hold_the_index_of_every_neighbour():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 23, 200)
    found, new = s._fuzzy(values, 23)
    assert set(new.sum(axis=1).tolist()) <= {1, 6}
    for v, keys in zip(values.tolist(), found, strict=True):
        for k in range(23):
            assert s.golay_index(np.array([v ^ 1 << k]))[0] in keys


def test_pairs_at_three_bits_share_a_key():
    rng = random.Random(2)
    for bits in range(4):
        for _ in range(150):
            a = rng.getrandbits(64)
            b = a
            for k in rng.sample(range(64), bits):
                b ^= 1 << k
            _, keys_a, roles_a = s.fuzzy_keys(np.array([a], np.uint64))
            _, keys_b, roles_b = s.fuzzy_keys(np.array([b], np.uint64))
            assert set(keys_a[roles_a == buckets.LOOKS].tolist()) & set(keys_b[roles_b == buckets.FILED].tolist())


def test_fingerprints(rows):
    for _, text, *_ in rows:
        for words in (3, 5):
            assert s.fingerprint(text.encode() if text is not None else None, words) == fingerprint(text, words)


def test_links_lose_none(spark):
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(60)]
    prints = {0, *centres}
    for x in centres[:30]:
        for _ in range(rng.randint(1, 40)):
            y = x
            for k in rng.sample(range(64), rng.randint(1, 5)):
                y ^= 1 << k
            prints.add(y)
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(x,) for x in signed], "print long").repartition(3)
    got = classes(signed, [(r.u, r.v) for r in s.print_links(frame).collect()])
    want = classes(signed, [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3])
    assert got == want


def test_large_buckets_are_split_and_lose_no_link(spark, monkeypatch):
    """Blocks of a few rows; hot keys with many blocks, beside keys of one row."""
    rng = random.Random(9)
    prints = [rng.getrandbits(63) for _ in range(40)]
    prints += [x ^ 1 << rng.randrange(63) for x in prints for _ in range(12)]
    rows = [(0, buckets.BOTH, x, x ^ 5) for x in prints] + [(k % 7, buckets.BOTH, x, x ^ 5) for k, x in enumerate(prints)] + [(100 + k, buckets.BOTH, x, x ^ 5) for k, x in enumerate(prints)]
    frame = spark.createDataFrame(rows, "key long, role byte, w0 long, w1 long").repartition(3)
    want = classes(prints, [(a, b) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= 1])
    assert len(set(want.values())) < 60
    for most in (40, 10**6):
        # The workers get the module by its name, so the limit goes through the function's own globals.
        monkeypatch.setattr(buckets, "MOST_ROWS", most)
        keyed = buckets.links(frame, 2, 2)
        assert ("InArrow" in keyed._jdf.queryExecution().toString()) == (most == 40)
        assert classes(prints, [(r.u0, r.v0) for r in keyed.collect()]) == want


def test_streamed_blocks(monkeypatch):
    """Roles: rows that only look up don't meet each other."""
    keys = np.zeros(3, np.int64)
    prints = np.array([[1], [1 ^ 2], [1 ^ 4]], np.uint64)
    u, v = buckets.bucket_links(keys, np.array([buckets.LOOKS, buckets.LOOKS, buckets.FILED], np.int8), prints, 1)
    assert sorted(zip(u.tolist(), v.tolist(), strict=True)) == [(0, 2)]
    many = np.arange(64, dtype=np.uint64)[:, None]
    u, v = buckets.bucket_links(np.zeros(64, np.int64), np.full(64, buckets.BOTH, np.int8), many, 1)
    assert len(u) == 63 and len({*classes(range(64), list(zip(u.tolist(), v.tolist(), strict=True))).values()}) == 1


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(-50, 150), rng.randint(-50, 150)) for _ in range(120)] + [(200, k) for k in range(300, 400)] + [(k, k + 1) for k in range(500, 560)]
    found = {r.u: r.root for r in c.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = classes({x for e in edges for x in e}, edges)
    assert {x: found.get(x, x) for x in want} == want
    u, root = c.forest(*(np.array(x) for x in zip(*edges, strict=True)))
    small = dict(zip(u.tolist(), root.tolist(), strict=True))
    assert {x: small.get(x, x) for x in want} == want


def test_groups_and_what_stays(docs, rows, empty):
    found = s.near_groups(docs, words=3).collect()
    prints = [fingerprint(x[1], 3) for x in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= 3]
    of = classes(range(len(rows)), links)
    least = {}
    for i, r in of.items():
        if rows[i][0] is not None:
            least[r] = min(least.get(r, 10**9), rows[i][0])
    want = Counter((rows[i][0], prints[i], least.get(r)) for i, r in of.items())
    assert Counter((r.doc_id, r.print & (1 << 64) - 1, r.component_id) for r in found) == want
    kept = s.keep_one(docs, words=3).collect()
    assert len(kept) == len(set(of.values())) and set(kept[0].asDict()) == set(docs.columns)
    assert {r.doc_id for r in kept if r.doc_id is not None} == set(least.values())
    assert s.near_groups(empty).count() == 0 and s.keep_one(empty).count() == 0
