"""A corpus from raw documents to token shards, in five stages that each use one operator of ``pixelspark.llm``.

Each stage reads all that the stage before it kept, from Parquet in the cluster's shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelspark.llm import decontaminate, langid, mixing, similar, wavelet
from pixelspark.llm.common import staged, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Shingle words and least Jaccard similarity of the near-dedup stage.
SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Bounds of the memory that encoding takes, lower than where it runs alone: here it shares an executor with what the
#: stages before it have left. The tokens are the same.
ENCODING = {"encode_bytes": 1 << 20, "kept_chunks": 500_000}


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits on the labelled documents that come in; drops those whose language can't be told, null and empty texts
    among them. Repeated rows are judged alike."""
    judged = langid.identify(docs, langid.fit(docs), lang_out="__lang", score_out="__score")
    return judged.where(F.col("__lang") != langid.UNKNOWN).drop("__lang", "__score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each group of near copies, null ids last, and one of repeated rows."""
    return similar.keep_one(docs, words=SHINGLE_WORDS, similarity=SIMILARITY)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of ``benchmark``."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents as often as the mixture of sources asks for, on a budget of the tokens that come in. Tokens are
    those of the output; documents without any, null texts too, are taken once."""
    counted = staged(wavelet.with_token_counts(docs, wavelet.default_tokenizer(), out="__n_tokens", **ENCODING), "counted")
    return mixing.mix_sources(counted, tokens_col="__n_tokens").select(*[F.col(f"`{x}`") for x in docs.columns])


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token shards, in the order of ``doc_id``, and returns what reading them gives, one row for each time
    that a document was taken."""
    return wavelet.token_output(docs, wavelet.default_tokenizer(), **ENCODING)


STAGES: list[tuple[str, Stage]] = [
    ("language identification", identify_language),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix),
    ("token output", write_tokens),
]

#: Neither fuzzy codes nor token ids can be had in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, f"stage-{name.replace(' ', '-')}")
    return docs
