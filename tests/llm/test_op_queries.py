"""The thin queries themselves, over all rows of the smallest tables, against plain computations of their contracts."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import pytest
from test_pii import brute
from test_simhash import classes, fingerprint

from pixelspark.llm import decontaminate, registry, tokencount, wavelet

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    return registry.QUERIES[name](spark, SF).collect()


def test_op1(spark, texts):
    tokenizer = wavelet.ChunkEncoder(wavelet.default_tokenizer())._tokenizer
    start, want = 0, []
    for k in sorted(texts):
        ids = [*tokenizer.encode(texts[k], add_special_tokens=False).ids, 0]
        want.append((k, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows(spark, "op1_wavelet")) == want


def test_op3(spark, texts):
    words = {k: [*WORD.findall("".join(c.lower() if c.isascii() else c for c in x)), "\n"] for k, x in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in texts}
    counts = Counter(w for k, own in words.items() if not held[k] for w in own)
    total, kinds = sum(counts.values()), len(counts)
    found = {r.doc_id: r for r in rows(spark, "op3_lattice_lm")}
    assert found.keys() == texts.keys()
    for k, own in words.items():
        r = found[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(own), sum(counts[w] > 0 for w in own), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in own))
        assert r.score < 0


def test_op4(spark, texts):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {r.doc_id: r for r in rows(spark, "op4_language_id")}
    assert found.keys() == texts.keys()
    for k, r in found.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[k]))
    held = [k for k in texts if found[k].held_out and lang[k] is not None and found[k].lang_pred != "und"]
    assert sum(found[k].lang_pred == lang[k] for k in held) >= 0.95 * len(held)


def test_op5(spark, texts):
    kinds = ("email", "ip", "card", "phone")
    for r in rows(spark, "op5_personal_data"):
        want = sorted(brute(texts[r.doc_id]), key=lambda x: (x[0], kinds.index(x[2])))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[2] == kind for x in want) for kind in kinds)
        lines = [f"{kind}:{a}:{b}" for a, b, kind in want]
        assert r.base_sha256 == hashlib.sha256(",".join(lines).encode()).hexdigest()
        assert set(lines) <= set(r.spans.split(",")) if lines else True


def test_op6(spark, texts):
    items = [(r.item_id, decontaminate.normal((r.text or "").encode())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = {(r.doc_id, r.item_id): r for r in rows(spark, "op6_decontaminate")}
    missed = near = 0
    for k, raw in texts.items():
        text = decontaminate.normal(raw.encode())
        for item, own in items:
            if len(own) < decontaminate.SHORT:
                continue
            exact = own in text
            leak = (0, 0) if exact else decontaminate.edit_search(own, text, decontaminate.edit_limit(len(own), 0.1))
            near += leak is not None
            if leak is None or (k, item) not in found:
                assert (k, item) not in found and not exact
                missed += leak is not None
            else:
                assert found[k, item].distance == leak[0]
    assert near and missed <= 0.05 * near


def test_op9(spark, texts):
    prints = {k: fingerprint("".join(c.lower() if c.isascii() else c for c in x), 3) for k, x in texts.items()}
    of = classes(list(texts), [(a, b) for a, b in itertools.combinations(texts, 2) if (prints[a] ^ prints[b]).bit_count() <= 3])
    least = {}
    for k, root in of.items():
        least[root] = min(least.get(root, k), k)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in rows(spark, "op9_simhash")) == sorted((k, f"{prints[k]:016x}", least[of[k]]) for k in texts)


def test_op10(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokencount.default_tokenizer())
    want = {k: (len(x.encode()), len(model.encode(x)), len(model.encode(x)) > 4096) for k, x in texts.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows(spark, "op10_token_counts")} == want
