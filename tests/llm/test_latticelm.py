import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pixelspark.llm import latticelm as m
from pixelspark.llm.common import crc_fold

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def tokens(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def all_segmentations(lattice, word):
    text = m.MARK + word
    if not text:
        return 0.0

    def rest(at):
        if at == len(text):
            return 1.0
        total = 0.0
        for end in range(at + 1, len(text) + 1):
            part = text[at:end]
            if part in lattice.pieces and m.MARK not in (part if at else part[1:]):
                total += 10 ** lattice.pieces[part] * rest(end)
        if text[at] not in lattice.pieces or (at and text[at] == m.MARK):
            total += 10 ** sum(lattice.bytes_[b] for b in text[at].encode()) * rest(at + 1)
        return total

    return math.log10(rest(0))


def test_forward_recursion_sums_all_segmentations():
    lattice = m.Lattice.from_counts(["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "abab", "<0x41>"], {"ab": 7, "▁a": 3, "a": 5, "b": 2}, 4)
    for word in ["a", "ab", "abab", "bababa", "aé", "▁a", "zzz", "a▁b"]:
        assert lattice.word(word) == pytest.approx(all_segmentations(lattice, word), rel=1e-9)
    total = sum(10**x for x in lattice.pieces.values()) + 10**lattice.end + 10 ** lattice.bytes_[0x41]
    assert total == pytest.approx(1.0)


@pytest.mark.parametrize("hot", [0, 5, 10_000])
def test_scores_against_brute_force(docs, rows, hot):
    train = crc_fold(F.col("doc_id"), 10) != 0
    found = m.score_documents(docs, m.default_vocabulary(), train=train, hot_words=hot).collect()
    assert len(found) == len(rows)
    in_train = lambda k: zlib.crc32(str("" if k is None else k).encode()) % 10 != 0
    counts, ends = Counter(), 0
    for k, text, *_ in rows:
        if in_train(k):
            counts.update(tokens(text))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    vocabulary = m.vocabulary_of(m.default_vocabulary())
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=m.default_vocabulary())
    pieces = Counter()
    for word, times in counts.items():
        for piece in model.encode(word, out_type=str):
            pieces[piece] += times
    # Pieces that the model spells in bytes are counted under their bytes.
    pieces = {model.id_to_piece(i): 0 for i in ()} | dict(pieces)
    by_id = Counter()
    for word, times in counts.items():
        for i in model.encode(word):
            by_id[model.id_to_piece(i)] += times
    lattice = m.Lattice.from_counts(vocabulary, dict(by_id), ends)
    log = lambda c: math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    want = Counter()
    for k, text, *_ in rows:
        words = tokens(text)
        base = sum(log(counts[x]) for x in words) + log(ends)
        score = sum(lattice.word(x) for x in words) + lattice.end
        want[k, in_train(k), len(words) + 1, sum(x in counts for x in words) + 1, n, round(base, 4), round(score, 4)] += 1
    got = Counter((r.doc_id, r.train, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in found)
    assert got == want


def test_empty_table_and_no_training_rows(docs, empty):
    assert m.score_documents(empty, m.default_vocabulary()).count() == 0
    found = m.score_documents(docs, m.default_vocabulary(), train=F.lit(False)).collect()
    assert all(r.base_score == 0 and r.n_known == 0 and r.score < 0 for r in found)
