import math
from collections import Counter

import pytest

from pixelspark.llm import mixing as x


def docs(spark, sizes, words=50):
    rows, k = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((k, "w " * (words + k % 7), source, 1, 2.0))
            k += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string, draw int, passes double").repartition(3)


def entropy(shares):
    return -sum(p * math.log(p) for p in shares if p)


@pytest.mark.parametrize("block", [1, 16, 4096])
def test_target_entropy_is_met(spark, block):
    d = docs(spark, {"big": 1200, "mid": 240, "tiny": 60})
    target = 0.9
    found = x.mix_sources(d, target_entropy=target, repeat_limit=None, block_docs=block, seed=3).collect()
    weights = {r.source: r["__weight"] for r in found}
    assert entropy(weights.values()) == pytest.approx(target, abs=1e-4) and sum(weights.values()) == pytest.approx(1)
    spent = Counter()
    for r in found:
        spent[r.source] += r["__tokens"]
    total = sum(r.text.count("w") for r in d.collect())
    for source, weight in weights.items():
        assert abs(spent[source] - weight * total) <= 60
    epochs = Counter((r.doc_id, r.source) for r in found)
    for source in weights:  # whole passes and a part: counts differ by one at most
        own = [epochs.get((r.doc_id, r.source), 0) for r in d.collect() if r.source == source]
        assert max(own) - min(own) <= 1
    assert all(0 <= r["__place"] <= 1 for r in found)
    first = Counter()
    for r in sorted(found, key=lambda r: r["__place"])[: len(found) // 2]:
        first[r.source] += r["__tokens"]
    assert all(abs(first[s] / sum(first.values()) - w) < 0.06 for s, w in weights.items())


def test_repetition_limit_binds(spark):
    d = docs(spark, {"big": 400, "tiny": 4})
    found = x.mix_sources(d, evenness=1.0, repeat_limit=3.0).collect()
    copies = Counter(r.doc_id for r in found if r.source == "tiny")
    assert max(copies.values()) == 3
    same = x.mix_sources(d, evenness=0.0, repeat_limit=None).collect()
    assert Counter(r.doc_id for r in same) == Counter(r.doc_id for r in d.collect())


def test_odd_rows(spark, rows, empty):
    d = spark.createDataFrame(rows, empty.schema)
    found = x.mix_sources(d, evenness=0.0, repeat_limit=None)
    assert found.columns[: len(d.columns)] == d.columns and found.count() == len(rows)
    assert x.mix_sources(empty).count() == 0
    assert x.mix_sources(d.where("text is null")).count() == 2


def test_budget(spark):
    d = docs(spark, {"a": 200, "b": 200})
    found = x.mix_sources(d, budget=5000, repeat_limit=None).collect()
    assert abs(sum(r["__tokens"] for r in found) - 5000) < 120


def test_tokens_of_the_caller_and_brute_force(spark):
    """Copies of each document by a plain computation of the method: weights by the exponent that meets the entropy,
    whole passes for every document of a source, and a last pass that spends what is left."""
    rows = [(k, f"text {k}", s, n) for k, (s, n) in enumerate([("a", 5 + k % 9) for k in range(300)] + [("b", 3 + k % 4) for k in range(60)] + [("c", 11) for _ in range(9)] + [(None, None), ("d", 0)])]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(3)
    found = x.mix_sources(d, tokens_col="n", evenness=0.9, repeat_limit=None, block_docs=8).collect()
    totals = Counter()
    for _, _, s, n in rows:
        totals[s or ""] += n or 0
    whole = sum(totals.values())
    share = {s: n / whole for s, n in totals.items() if n}
    weights = lambda e: {s: p**e / sum(q**e for q in share.values()) for s, p in share.items()}
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if entropy(weights(mid).values()) <= 0.9 * math.log(len(share)) else (mid, high)
    want = weights(high)
    assert {r.source: r["__weight"] for r in found if r.source in want} == pytest.approx(want, abs=1e-6)
    copies, spent = Counter(r.doc_id for r in found), Counter()
    for r in found:
        spent[r.source or ""] += r["__tokens"]
    for k, _, s, n in rows:
        passes = want[s] * whole / totals[s] if s in want else 1
        assert copies[k] in {math.floor(passes + 1e-9), math.ceil(passes - 1e-9)}
    assert all(abs(spent[s] - w * whole) <= 14 for s, w in want.items())


def test_clashing_names(spark):
    d = spark.createDataFrame([(1, "w w", "a", 5, "x", 7, 0.5), (2, "w", "b", 6, "y", 8, 0.25)], "doc_id long, text string, source string, __key int, `__cut.x` string, __draw int, __place double")
    found = x.mix_sources(d, evenness=0.0, repeat_limit=None)
    assert found.columns[:6] == d.columns[:6] and sorted(r["__key"] for r in found.collect()) == [5, 6]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    from pixelspark.llm.wavelet import ChunkEncoder, default_tokenizer

    encoder = ChunkEncoder(default_tokenizer())
    want = {r.doc_id: len(encoder._tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = x.op8_mix_sources(spark, sf).collect()
    assert all(want[r.doc_id] == r.n_tokens for r in found) and abs(sum(r.n_tokens for r in found) / sum(want.values()) - 1) < 0.1
