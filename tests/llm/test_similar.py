import itertools
import random
import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as p  # noqa: E402
from pixelspark.llm import similar as s  # noqa: E402
from pixelspark.llm.common import table  # noqa: E402

SF = "/root/testdata/sf0.001"


def shingles(text):
    tokens = (text or "").encode().lower().split()
    return {b" ".join(tokens[k : k + 5]) for k in range(max(1, len(tokens) - 4))} if tokens else set()


def kept(rows):
    """Ids that single-link grouping at 0.8 keeps, by brute force."""
    sets = [(r[0], shingles(r[1])) for r in rows]
    of = {i: i for i, _ in sets}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a == b or len(a & b) / len(a | b) >= 0.8:
            i, j = sorted((find(i), find(j)))
            of[j] = i
    return sorted({find(i) for i in of})


def test_stage_drops_what_is_alike(spark):
    rng = random.Random(7)
    rows = []
    for k in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(20, 300))]
        rows.append((4 * k, " ".join(words)))
        for n in range(1, 4):  # a chain, each text some words from the one before it
            words = list(words)
            for _ in range(max(1, len(words) * n // 150)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((4 * k + n, " ".join(words)))
    rows += [(9000, None), (9001, " "), (9002, "one two"), (9003, "One  two"), (9004, "one two three")]
    found = p.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    want = kept(rows)
    assert sorted(r.doc_id for r in found.collect()) == want and 60 < len(want) < len(rows) - 30


def test_stage_on_the_documents(spark):
    docs = table(spark, SF, "documents")
    found = p.drop_near_copies(spark, docs, SF)
    assert found.columns == docs.columns
    assert sorted(r.doc_id for r in found.collect()) == kept([(r.doc_id, r.text) for r in docs.collect()])


def test_exactly_at_the_limit():
    a = np.arange(9, dtype=np.uint64)
    assert s.linked([a, a[:8], a[:6]], 0.8).tolist() == [0, 0, 2]
    assert s.linked([a[:4], a[:5]], 0.8).tolist() == [0, 0]


def pair(rng, n, share):
    """Two sets of which ``share`` of the union is common."""
    both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    own = (n - round(n * share)) // 2
    return np.unique(both[: n - own]), np.unique(both[own:])


def test_keys_meet_at_the_limit():
    rng = np.random.default_rng(5)
    for n in (10, 40, 150, 600):
        pairs = [pair(rng, n, 0.8) for _ in range(400)]
        assert min(len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for a, b in pairs) >= 0.8
        one, two = (s.bit_counts([x[k] for x in pairs]) for k in (0, 1))
        meet = [len(np.intersect1d(a, b)) > 0 for a, b in zip(s.segment_keys(s.near_codes(one)), s.segment_keys(s.near_codes(two)), strict=True)]
        near = np.bitwise_count(s.check_words(one) ^ s.check_words(two)).sum(axis=1) <= s.MOST_BITS
        assert (np.array(meet) & near).mean() >= 0.99


def test_counts_of_long_and_short_sets(monkeypatch):
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 255, 256, 1, 3000, 510, 2)]
    want = s.bit_counts(sets)
    monkeypatch.setattr(s, "BLOCK", 300)
    assert (s.bit_counts(sets) == want).all()
    for x, got in zip(sets, want, strict=True):
        first = np.sort(got[:64])
        ones = np.array([int(((x >> np.uint64(k)) & np.uint64(1)).sum()) for k in range(64)])
        assert (first == np.sort(2 * ones - len(x))).all()


def test_large_groups_are_split_and_lose_no_link(spark, monkeypatch):
    """Groups of a hub and its copies, a chain, and two classes that no link joins, in blocks of a few sets."""
    rng = random.Random(3)
    rows = []
    for g in range(3):
        base = [rng.getrandbits(62) for _ in range(60)]
        for k in range(40):
            own = list(base)
            for at in rng.sample(range(60), 3):
                own[at] = rng.getrandbits(62)
            rows.append((g, own))
    chain = [rng.getrandbits(62) for _ in range(60)]
    for k in range(50):
        chain = chain[4:] + [rng.getrandbits(62) for _ in range(4)]
        rows.append((7, chain))
    for half in range(2):
        base = [rng.getrandbits(62) for _ in range(60)]
        rows += [(9, base[k:] + [rng.getrandbits(62) for _ in range(k)]) for k in range(6)]
    sets = [np.unique(np.array(x, np.uint64)) for _, x in rows]
    frame = spark.createDataFrame([(g, s.set_hash(x), x.tobytes()) for (g, _), x in zip(rows, sets, strict=True)], "group long, node long, shingles binary").repartition(3)
    of = {s.set_hash(x): s.set_hash(x) for x in sets}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if rows[i][0] == rows[j][0] and len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.8:
            of[find(s.set_hash(sets[i]))] = find(s.set_hash(sets[j]))
    want = {}
    for x in of:
        want.setdefault(find(x), set()).add(x)
    for size in (1000, 10):
        monkeypatch.setattr(s, "BLOCK_SETS", size)
        monkeypatch.setattr(s, "ANCHORS", 2)
        found = {r.node: r.root for r in s._verified(frame, 0.8).collect()}
        got = {}
        for x in of:
            got.setdefault(found.get(x, x), set()).add(x)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_odd_tables(docs, rows, empty):
    found = s.keep_one(docs).collect()
    assert set(found[0].asDict()) == set(docs.columns) and s.keep_one(empty).count() == 0
    assert len(found) == len(kept([(k, r[1]) for k, r in enumerate(rows)]))
