import random

import numpy as np
import pytest

from pixelspark.llm import decontaminate as d


def distance(item, text):
    last = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (a != b)))
        last = now
    return min(last)


def test_edit_search_against_the_plain_table():
    rng = random.Random(1)
    for _ in range(300):
        item = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 70)))
        text = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 90)))
        best = distance(item, text)
        found = d.edit_search(item, text, len(item))
        assert (found[0] if found else len(item)) == best
        assert d.edit_search(item, text, best) is not None or best == len(item)
        assert best == 0 or d.edit_search(item, text, best - 1) is None


def make(seed, items=40, texts=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    passage = lambda n: " ".join(rng.choice(words) for _ in range(n))
    return rng, [(k, passage(rng.randint(6, 50))) for k in range(items)], [passage(rng.randint(5, 200)) for _ in range(texts)]


def test_recall_and_precision_against_brute_force():
    rng, items, texts = make(5)
    block = d.Items.of([(k, x.encode()) for k, x in items])
    search, edits = d.Search(block), np.random.default_rng(4)
    planted = []
    for k, text in enumerate(block.texts):
        host = texts[k].encode()
        changed = d._edited(text, int(block.limits[k]), edits)
        at = rng.randint(0, len(host))
        planted.append(host[:at] + b" " + changed + b" " + host[at:])
    found = search.find([d.normal(x) for x in planted])
    hits = sum(any(x[0] == k for x in found[k]) for k in range(len(planted)))
    assert hits / len(planted) >= 0.95
    for k, own in enumerate(found):
        text = d.normal(planted[k])
        for item, gap, start, end in own:
            assert gap <= block.limits[item] and 0 <= start < end <= len(text)
            assert gap == distance(block.texts[item], text[max(0, start - 60) : end + 60])


def test_exact_passages_are_all_found(spark):
    rng, items, texts = make(8)
    rows = []
    for k, text in enumerate(texts):
        item = items[k % len(items)][1] if k % 3 == 0 else None
        rows.append((k, text if item is None else f"{text[:50]} {item.upper()}\n\n{text[50:]}", "x"))
    rows += [(500, None, "x"), (501, "", "x"), (502, "short", "x"), rows[0], rows[0], (None, rows[3][1], "x"), (503, " ".join(texts * 30) + " " + items[1][1], "x")]
    items = items + [(900, None), (901, ""), (902, "tiny"), (903, items[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `end` string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = d.find_leaks(docs, bench).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.item_id) for r in found if r.distance == 0)
    want = sorted((-1 if k is None else k, i) for k, x, _ in rows for i, y in items if x and y and d.normal(y.encode()) and (d.normal(y.encode()) in d.normal(x.encode()) if len(d.normal(y.encode())) >= 16 else b' ' + d.normal(y.encode()) + b' ' in b' ' + d.normal(x.encode()) + b' '))
    assert got == want and len(want) > 40
    dirty = {x for k, x in got} and {-1 if r.doc_id is None else r.doc_id for r in found}
    kept = d.without_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted(k for k, _, _ in ((-1 if k is None else k, x, y) for k, x, y in rows) if k not in dirty)
    assert d.find_leaks(docs.limit(0), bench).count() == 0 and d.find_leaks(docs, bench.limit(0)).count() == 0
    assert d.without_leaks(docs, bench.limit(0)).count() == len(rows)


def test_blocks_cover_all_items(spark):
    bench = spark.createDataFrame([(k, f"item number {k} with some words") for k in range(50)], "item_id long, text string")
    blocks = list(d.item_blocks(bench, block_bytes=300))
    assert len(blocks) > 3 and sorted(k for b in blocks for k, _ in b) == list(range(50))


@pytest.mark.parametrize("size", [20, 30, 40, 79, 150, 400, 1000, 2000, 4000])
def test_recall_at_the_limit_of_any_size(size):
    rng, edits = np.random.default_rng(size), np.random.default_rng(size + 1)
    letters = np.frombuffer(b"abcdefghijklmnop rstuvw yz", np.uint8)
    items = [(k, letters[rng.integers(0, len(letters), size)].tobytes().replace(b"  ", b"ab").strip().ljust(size, b"x")) for k in range(100 if size < 1000 else 40)]
    block = d.Items.of(items)
    assert (block.limits == size // 10).all()
    texts = [d.normal(b"some words before it " + d._edited(x, int(n), edits) + b" and some after it") for x, n in zip(block.texts, block.limits, strict=True)]
    found = d.Search(block).find(texts)
    # White space that an edit doubles is one edit more, so not all are within the limit.
    near = [d.edit_search(x, text, int(n)) is not None for x, text, n in zip(block.texts, texts, block.limits, strict=True)]
    hits = [any(x[0] == k for x in own) for k, own in enumerate(found)]
    assert sum(near) >= 0.9 * len(near) and sum(h for h, n in zip(hits, near, strict=True) if n) >= 0.95 * sum(near)


def test_short_items_by_their_words():
    block = d.Items.of([(0, b"Tiny"), (1, b"a b"), (2, b"fifteen letters"), (3, b"x"), (4, b" "), (5, None)])
    texts = [b"a tiny one", b"tinyest", b"aa b", b"is a b", b"fifteen lettersx, fifteen letters", b"fifteen lettrs", b"x", b"xx"]
    assert [[(k, a, b) for k, _, a, b in own] for own in d.Search(block).find(texts)] == [[(0, 2, 6)], [], [], [(1, 3, 6)], [(2, 18, 33)], [], [(3, 0, 1)], []]


def test_many_hits_are_taken_in_runs(monkeypatch):
    items = [(k, b"a" * 40 + b" item %d of many" % k) for k in range(50)]
    texts = [b"a" * 2000, b"b" * 50 + b" " + items[7][1] + b" c", items[3][1], b"", b"a" * 300 + b" " + items[9][1]]
    want = d.Search(d.Items.of(items)).find(texts)
    sizes = []
    windows = d.Search._windows
    monkeypatch.setattr(d, "MOST_HITS", 3000)
    monkeypatch.setattr(d.Search, "_windows", lambda self, size, starts, place, item, at: sizes.append(len(place)) or windows(self, size, starts, place, item, at))
    assert d.Search(d.Items.of(items)).find(texts) == want and want[1] and want[2]
    assert max(sizes) < 20_000 and len(sizes) > 100
