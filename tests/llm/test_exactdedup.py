import hashlib
from collections import Counter

import pytest

from pixelspark.llm.exactdedup import exact_groups


def brute(rows):
    groups = {}
    for k, text in rows:
        groups.setdefault(text or "", []).append(k)
    out = Counter()
    for k, text in rows:
        own = groups[text or ""]
        ids = [x for x in own if x is not None]
        out[k, max(ids) if ids else None, len(own), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    return out, len(groups)


@pytest.mark.parametrize("prefix", [1, 256])
def test_against_brute_force(spark, rows, prefix):
    own = [(x[0], x[1], 1, 2) for x in rows] + [(200 + k, "same" if k % 3 else "sbme", 1, 2) for k in range(300)] + [(7, "same", 1, 2)] * 3
    docs = spark.createDataFrame(own, "doc_id long, text string, n int, prefix int").repartition(4)
    want, groups = brute([x[:2] for x in own])
    found = exact_groups(docs, prefix_chars=prefix, digest_all=True).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == want
    kept = [r for r in found if r.kept]
    assert len(kept) == groups and all(r.doc_id == r.keep_id for r in kept)


def test_alone_texts_are_not_hashed(spark):
    docs = spark.createDataFrame([(k, "x" * k) for k in range(50)] + [(99, "x" * 7)], "doc_id long, text string")
    found = {r.doc_id: r for r in exact_groups(docs).collect()}
    assert found[7].text_sha256 and found[99].kept and not found[7].kept
    assert sum(r.text_sha256 is not None for r in found.values()) < 10


def test_empty(empty):
    assert exact_groups(empty).count() == 0
