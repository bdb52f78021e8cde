from collections import Counter

import public_tokenizers
import pytest

from pixelspark.llm import tokencount as t


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_are_those_of_the_library(docs, rows, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = lambda x: len(model.encode(x))
    else:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        plain = lambda x: len(model.encode(x, add_special_tokens=False).ids)
    found = t.count_tokens(docs, path, limit=100).collect()
    want = Counter((x[0], len((x[1] or "").encode()), plain(x[1] or ""), plain(x[1] or "") > 100) for x in rows)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in found) == want


def test_split_only_at_safe_spaces():
    text = "ab  cd " * 2000 + "ef gh. Ij kl" * 2000
    for keep in (True, False):
        pieces = t.split_text(text, keep, 100)
        assert len(pieces) > 50 and ("" if keep else " ").join(pieces) == text
    assert t.split_text("x" * 100_000, True) == ["x" * 100_000]


def test_empty(empty):
    assert t.count_tokens(empty, t.default_tokenizer()).count() == 0
