import gc
import json
import weakref
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pixelspark.llm import common
from pixelspark.llm import wavelet as w


@pytest.mark.parametrize("size,kinds", [(0, 1), (1, 1), (7, 3), (5000, 40), (70_000, 3000)])
def test_shard_answers_like_the_plain_list(size, kinds):
    rng = np.random.default_rng(size)
    ids = rng.zipf(1.4, size).clip(0, kinds).astype("<u2")
    shard = w.WaveletShard(w.build_shard(ids, [1, None], np.array([0, size // 2, size]), block_bits=1024))
    assert (shard.decode() == ids).all() and shard.n == size
    assert shard.doc_ids == [1, None] and shard.doc_starts.tolist() == [0, size // 2, size]
    for i in rng.integers(0, max(size, 1), 30 if size else 0):
        token = int(ids[i])
        assert shard.access(int(i)) == token
        assert shard.rank(token, int(i)) == int((ids[:i] == token).sum())
        places = np.flatnonzero(ids == token)
        k = int(rng.integers(0, len(places)))
        assert shard.select(token, k) == places[k] and shard.count(token) == len(places)
    if size:
        token = int(ids[0])
        assert shard.occurrences(token)[:50] == np.flatnonzero(ids == token)[:50].tolist() if (ids == token).sum() <= 50 else True
    assert shard.count(65_000) == 0


def test_damage_is_noticed():
    raw = bytearray(w.build_shard(np.arange(50, dtype="<u2"), [1], np.array([0, 50])))
    raw[len(raw) // 2] ^= 1
    with pytest.raises(ValueError):
        w.WaveletShard(bytes(raw))
    with pytest.raises(ValueError):
        w.WaveletShard(b"short")


def test_chunks_give_the_ids_of_whole_texts(rows):
    encoder = w.ChunkEncoder(w.default_tokenizer(), most=20)
    texts = [x[1] or "" for x in rows] + ["", " a", "a ", "a  b", "x <|endoftext|> y", "\n a b", "don't it's 12ab 3 x\u0301a.b, c\n d", "½ ²x, ñandú \u2003 z", "a.\nB c,\nd"]
    for _ in range(2):  # once learning, once from what is kept
        ids, counts = encoder.encode(pa.array(texts))
        plain = [x.ids for x in encoder._tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert counts.tolist() == [len(x) for x in plain]
        assert ids.tolist() == [y for x in plain for y in x]


def test_a_word_is_encoded_once_whatever_follows_it():
    encoder = w.ChunkEncoder(w.default_tokenizer())
    words = [f"{a}{b}{c}é" for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwx"]
    encoder.encode(pa.array([" ".join(x + y for x in words) for y in (",", ".", "!?", ".\nOf", "'s")]))
    assert encoder._kept._n <= len(words) + 10


def test_cut_chunks_give_the_ids_of_whole_texts():
    encoder, rng = w.ChunkEncoder(w.default_tokenizer()), np.random.default_rng(5)
    parts = ["a", "Word", "é", "ß", "ſ", "ŉ", "×", "÷", "ƀ", "ж", "中", "x\u0301", "\u00ad", "'", "'s", "'ll", "don't", "7", "12", "½", ".", ",", "\n", "\t", "\r\n", " ", " ", " ", " ", "\u00a0", "\x00", "_", "🙂", "supercalifragilistic", "<|endoftext|>", "<|endo", "text|>"]
    likely = np.array([8.0 if x.isalpha() or x == " " else 0.1 if x.startswith("<") else 1.0 for x in parts])
    texts = ["".join(rng.choice(parts, n, p=likely / likely.sum())) for n in rng.integers(0, 40, 4000)]
    plain = [x.ids for x in encoder._tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        ids, counts = encoder.encode(pa.array(texts))
        assert counts.tolist() == [len(x) for x in plain]
        assert ids.tolist() == [y for x in plain for y in x]


def test_a_tokenizer_that_puts_a_space_first(tmp_path):
    with open(w.default_tokenizer(), encoding="utf-8") as file:
        kind = json.load(file)
    kind["pre_tokenizer"]["add_prefix_space"] = True
    (path := tmp_path / "spaced.json").write_text(json.dumps(kind), encoding="utf-8")
    encoder, texts = w.ChunkEncoder(str(path)), ["a, b.", ".c", "", "d e"]
    assert encoder.encode(pa.array(texts))[0].tolist() == [y for x in texts for y in encoder._tokenizer.encode(x, add_special_tokens=False).ids]


def test_documents_come_back_in_order(spark, docs, rows):
    found = w.token_output(docs, w.default_tokenizer(), end_id=0, shard_tokens=500).orderBy("start").collect()
    encoder = w.ChunkEncoder(w.default_tokenizer())
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, (x[1] or "").encode()))
    start = 0
    for row, got in zip(order, found, strict=True):
        ids = encoder._tokenizer.encode(row[1] or "", add_special_tokens=False).ids + [0]
        assert (got.doc_id, got.start, got.n_tokens, got.ids_crc32) == (row[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len({x.shard for x in found}) > 1


def test_empty_table(empty):
    assert w.token_output(empty, w.default_tokenizer()).count() == 0


def test_other_operators_let_the_encoder_go():
    encoder = weakref.ref(w.encoder_for(w.default_tokenizer()))
    gc.collect()
    assert encoder() is not None and w.encoder_for(w.default_tokenizer()) is encoder()
    assert list(common.pieces([pa.record_batch({"x": [1]})]))
    gc.collect()
    assert encoder() is None


def test_the_table_grows_with_its_chunks(rows):
    encoder = w.ChunkEncoder(w.default_tokenizer())
    encoder.encode(pa.array([x[1] or "" for x in rows]))
    assert sum(x.nbytes for x in vars(encoder._kept).values() if isinstance(x, np.ndarray)) < 1 << 20
    table, rng = w.ChunkTable(2), np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 40, (50_000, 2), np.uint64), axis=0)
    for at in range(0, len(keys), 7000):
        table.put(keys[at : at + 7000], np.arange(at, min(len(keys), at + 7000), dtype=np.int32))
    assert (table.find(keys) == np.arange(len(keys))).all() and (table.find(keys + np.uint64(1 << 41)) == -1).all()


def test_counts_with_little_memory(spark, docs, rows):
    tokenizer = w.ChunkEncoder(w.default_tokenizer())._tokenizer
    want = sorted((-1 if x[0] is None else x[0], x[1], len(tokenizer.encode(x[1] or "", add_special_tokens=False).ids)) for x in rows if x[1] is not None)
    found = w.with_token_counts(docs, w.default_tokenizer(), out="n", encode_bytes=3000, kept_chunks=5)
    assert found.columns == [*docs.columns, "n"]
    got = found.select("doc_id", "text", "n").collect()
    assert sorted((-1 if x.doc_id is None else x.doc_id, x.text, x.n) for x in got if x.text is not None) == want
    assert [x.n for x in got if x.text is None] == [0] * sum(x[1] is None for x in rows)
    instead = w.with_token_counts(docs, w.default_tokenizer(), out="text")
    assert instead.columns == [*(x for x in docs.columns if x != "text"), "text"]
    assert sorted(x["text"] for x in instead.select("text").collect()) == sorted(x.n for x in got)
