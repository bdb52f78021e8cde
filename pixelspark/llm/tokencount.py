"""Token counts: whole texts encoded in batches inside Arrow functions that return lengths only."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table

#: A text longer than this many characters is split where that can't change its tokens.
PIECE_CHARS = 4096
#: Characters handed to the encoder in one call, so that a call's memory doesn't depend on the rows of a batch.
CALL_CHARS = 1 << 20
#: A space between two ASCII letters or digits: no normalisation joins across it, and no piece holds one inside.
SAFE = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


def split_text(text: str, keep_space: bool, piece_chars: int = PIECE_CHARS) -> list[str]:
    """``text`` in pieces of about ``piece_chars``, cut at safe spaces; where there is none, a piece goes on."""
    if len(text) <= piece_chars:
        return [text]
    pieces, start = [], 0
    while len(text) - start > piece_chars and (cut := SAFE.search(text, start + piece_chars)):
        pieces.append(text[start : cut.start()])
        start = cut.start() if keep_space else cut.end()
    return [*pieces, text[start:]]


def load_counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to their numbers of tokens, for a sentencepiece ``.model`` or a tokenizers ``.json``."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        # The model puts a mark for a space before each text, so a piece after a cut space keeps its tokens. That
        # holds if no vocabulary entry has that mark after another character.
        pieces = [model.id_to_piece(k) for k in range(model.get_piece_size())]
        dummy = model.encode("a b", out_type=str) == [*model.encode("a", out_type=str), *model.encode("b", out_type=str)]
        safe = dummy and not any("▁" in x.lstrip("▁") for x in pieces)
        keep_space = False
        encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    else:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            kind = json.load(file)
        before = kind.get("pre_tokenizer") or {}
        safe = before.get("type") == "ByteLevel" and bool(before.get("use_regex", True)) and not kind.get("normalizer")
        keep_space = True
        encode = lambda texts: [len(x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(texts: list[str]) -> list[int]:
        totals = [0] * len(texts)
        held: list[str] = []
        owners: list[int] = []
        size = 0

        def flush() -> None:
            for owner, n in zip(owners, encode(held), strict=True):
                totals[owner] += n
            held.clear()
            owners.clear()

        for k, text in enumerate(texts):
            for piece in split_text(text, keep_space) if safe else [text]:
                if piece:
                    held.append(piece)
                    owners.append(k)
                    size += len(piece)
                if size >= CALL_CHARS:
                    flush()
                    size = 0
        if held:
            flush()
        return totals

    return count


def count_tokens(docs: DataFrame, tokenizer: str, *, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``id_col``, n_bytes, n_tokens and whether that is over ``limit``.

    A null text counts as empty: no bytes, no tokens. Repeated rows and equal or null ids each give their row; an
    empty table gives an empty result. Only the two named columns are read, so others may have any name.
    """
    name = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("__id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for part in pieces(batches, 512):
            count = count or load_counter(tokenizer)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(count(part.column(2).to_pylist()), pa.int64())], ["__id", "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(run, f"__id {name}, n_bytes long, n_tokens long")
    return counted.select(F.col("__id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents; null and empty texts have none, repeated rows each have theirs."""
    return count_tokens(table(spark, sf_dir, "documents"), default_tokenizer())
