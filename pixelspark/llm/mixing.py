"""Temperature mixing of sources, realised as budgeted block permutations.

A source's weight is its share of tokens to the power of an exponent, normalised; 1 keeps the shares, 0 makes all
sources equal. The exponent is bisected to the target entropy, or to the least that keeps every source within the
repetition limit, whichever is larger. A source of weight w has w times the token budget: whole passes over its
documents while they fit, then a part of one more. Documents are dealt into blocks by a hash; the part takes blocks in
the order of a permutation seeded by the pass, and documents in a hash's order from the block that the budget cuts.

So which documents stay follows from a few numbers a source: texts are never shuffled, and windows see block totals
and the documents of one block a source.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, staged, table
from .wavelet import default_tokenizer, with_token_counts

#: The target as a share of the entropy of equal weights.
TARGET_EVENNESS = 0.95
REPEAT_LIMIT = 4.0
BLOCK_DOCS = 4096
#: Points that one pass over the sources' totals tries, and passes: 16 ** 8 steps of the exponent.
POINTS, PASSES = 16, 8
#: The numbers of so many sources are broadcast; more are joined by a shuffle, whose skewed side Spark splits.
BROADCAST_SOURCES = 20_000


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE}]+")).cast("long")


@dataclass
class Mix:
    """The exponent that was found, and the entropy and most repetitions that it gives."""

    exponent: float
    entropy: float
    repeats: float
    log_norm: float


def _at(sources: DataFrame, exponents: list[float], budget_share: float) -> list[Mix]:
    """Entropy and repetitions at each exponent, in one pass over ``sources`` (share > 0)."""
    log_share = F.log("share")
    found = []
    for k, x in enumerate(exponents):
        part = F.exp(log_share * x)
        found += [F.sum(part).alias(f"z{k}"), F.sum(part * log_share).alias(f"l{k}"), F.max(F.exp(log_share * (x - 1))).alias(f"m{k}")]
    row = sources.where("share > 0").agg(*found).first()
    out = []
    for k, x in enumerate(exponents):
        z = row[f"z{k}"] or 1.0
        out.append(Mix(x, math.log(z) - x * (row[f"l{k}"] or 0.0) / z, budget_share * (row[f"m{k}"] or 0.0) / z, math.log(z)))
    return out


def solve(sources: DataFrame, *, target_entropy: float | None, evenness: float = TARGET_EVENNESS, repeat_limit: float | None = REPEAT_LIMIT, budget_share: float = 1.0) -> Mix:
    """Bisects the exponent between 0 and 1. Entropy falls and repetitions fall as it rises. A target that even equal
    weights miss gives 0, one that the shares themselves exceed gives 1."""
    ends = _at(sources, [0.0, 1.0], budget_share)
    target = target_entropy if target_entropy is not None else evenness * ends[0].entropy

    def fits(x: Mix) -> bool:
        return x.entropy <= target + 1e-12

    def least(good: object) -> float:
        low, high = 0.0, 1.0
        if good(ends[0]):
            return 0.0
        if not good(ends[1]):
            return 1.0
        for _ in range(PASSES):
            points = [low + (high - low) * k / POINTS for k in range(1, POINTS)]
            good_ones = [x.exponent for x in _at(sources, points, budget_share) if good(x)]
            high_ = min(good_ones, default=high)
            low = max((x for x in points if x < high_), default=low)
            high = high_
        return high

    exponent = least(fits)
    if repeat_limit is not None:
        exponent = max(exponent, least(lambda x: x.repeats <= repeat_limit + 1e-12))
    return _at(sources, [exponent], budget_share)[0]


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    tokens_col: str | None = None,
    target_entropy: float | None = None,
    evenness: float = TARGET_EVENNESS,
    repeat_limit: float | None = REPEAT_LIMIT,
    budget: int | None = None,
    seed: int = 0,
    block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """``docs`` as often as the mixture takes each row, with __tokens, __weight (of the source), __epoch (from 1),
    __block and __place: sorted by __place, from 0 to 1, every stretch of the stream has the target weights.

    ``tokens_col`` has the tokens of each row, null as none; without it, words stand for tokens. ``budget`` is in
    tokens; the default is what ``docs`` have. A null source counts as the empty one, a null text as empty; texts
    without tokens cost nothing and are taken once. Equal rows share a place in the permutation and are taken or left
    together. An empty table gives an empty result. Rows travel as one struct, so their columns may have any names;
    columns with the five names of the result are replaced.
    """
    new = ["__tokens", "__weight", "__epoch", "__block", "__place"]
    names = [x for x in docs.columns if x not in new]
    source = F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(""))
    draw = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    tokens = count_words(F.col(f"`{text_col}`")) if tokens_col is None else F.coalesce(F.col(f"`{tokens_col}`").cast("long"), F.lit(0))
    skinny = staged(docs.select(source.alias("source"), draw.alias("draw"), tokens.alias("tokens")), "mix-rows")
    sums = skinny.groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    total = sums.agg(F.sum("tokens").alias("t"), F.count("*").alias("k")).first()
    words, kinds = total.t or 0, total.k
    sums = staged(sums.withColumn("share", F.col("tokens") / F.lit(float(max(words, 1)))), "mix-sources")
    budget = words if budget is None else budget
    mix = solve(sums, target_entropy=target_entropy, evenness=evenness, repeat_limit=repeat_limit, budget_share=budget / max(words, 1))
    weight = F.when(F.col("share") > 0, F.exp(F.log("share") * mix.exponent - mix.log_norm)).otherwise(0.0)
    plan = sums.withColumn("weight", weight).withColumn("passes", F.when(F.col("tokens") > 0, F.col("weight") * budget / F.col("tokens")).otherwise(1.0))
    plan = plan.select("source", "weight", "passes", F.floor("passes").alias("full"), F.ceil(F.col("n") / block_docs).alias("blocks"), ((F.col("passes") - F.floor("passes")) * F.col("tokens")).alias("rest"))
    plan = staged(plan, "mix-plan")
    near = (lambda x: F.broadcast(x)) if kinds <= BROADCAST_SOURCES else (lambda x: x)
    block, inner = F.pmod("draw", "blocks"), F.xxhash64("draw", F.lit("inside"))
    order = F.xxhash64(F.lit(seed), "full", "source", "block")

    # The block that the last pass's budget cuts, by the permutation's order; then the place inside it.
    placed = skinny.join(near(plan), "source").withColumn("block", block)
    totals = placed.groupBy("source", "block").agg(F.sum("tokens").alias("tokens"), F.first("full").alias("full"), F.first("rest").alias("rest")).withColumn("order", order)
    by_order = Window.partitionBy("source").orderBy("order", "block")
    after = totals.withColumn("after", F.sum("tokens").over(by_order.rowsBetween(Window.unboundedPreceding, 0)))
    cuts = after.where("after > rest").groupBy("source").agg(F.min(F.struct("order", "block", (F.col("rest") - F.col("after") + F.col("tokens")).alias("left"))).alias("cut"))
    cuts = staged(cuts.select("source", "cut.*").withColumnsRenamed({"order": "cut_order", "block": "cut_block", "left": "cut_left"}), "mix-cuts")
    inside = placed.join(near(cuts), "source").where("block = cut_block").groupBy("source", "cut_left", inner.alias("inner")).agg(F.sum("tokens").alias("tokens"))
    so_far = Window.partitionBy("source").orderBy("inner").rowsBetween(Window.unboundedPreceding, 0)
    half = F.sum("tokens").over(so_far) - F.col("tokens") / 2  # a document is in if its middle is
    last = inside.withColumn("half", half).where("half <= cut_left").groupBy("source").agg(F.max("inner").alias("cut_inner"))
    numbers = staged(plan.join(cuts, "source", "left").join(last, "source", "left"), "mix-numbers")

    renamed = numbers.select(*[F.col(x).alias(f"__{x}") for x in numbers.columns])
    rows = docs.select(F.struct(*[F.col(f"`{x}`") for x in names]).alias("__row"), source.alias("__key"), draw.alias("__draw"), tokens.alias("__tokens")).join(near(renamed), F.col("__key") == F.col("__source"))
    rows = rows.withColumn("__block", F.pmod("__draw", "__blocks"))
    rows = rows.withColumns({"__order": F.xxhash64(F.lit(seed), "__full", "__source", "__block"), "__inner": F.xxhash64("__draw", F.lit("inside"))})
    before = (F.col("__order") < F.col("__cut_order")) | ((F.col("__order") == F.col("__cut_order")) & (F.col("__block") < F.col("__cut_block")))
    at_cut = (F.col("__block") == F.col("__cut_block")) & (F.col("__inner") <= F.col("__cut_inner"))
    part = F.coalesce(F.col("__cut_order").isNull() & (F.col("__rest") > 0) | before | at_cut, F.lit(False))
    copies = (F.col("__full") + F.when(part, 1).otherwise(0)).cast("int")
    rows = rows.where(copies > 0).withColumn("__epoch", F.explode(F.sequence(F.lit(1), copies)))
    turn = F.xxhash64(F.lit(seed), "__epoch", "__source", "__block", "__inner") / F.lit(2.0**64) + 0.5
    place = F.least((F.col("__epoch") - 1 + turn * F.least(F.lit(1.0), F.col("__passes") - F.col("__epoch") + 1)) / F.col("__passes"), F.lit(1.0))
    return rows.withColumn("__place", place).select(*[F.col("__row").getField(x).alias(x) for x in names], *new)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by the mixture of their sources, by tokens of ``byte_bpe_50k.json``. Texts are read once, for their
    tokens and hashes; null ones have none, an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    counted = with_token_counts(docs, default_tokenizer(), out="n_tokens").select("doc_id", "source", F.xxhash64("text").alias("text"), "n_tokens")
    mixed = mix_sources(staged(counted, "mix-tokens"), tokens_col="n_tokens")
    return mixed.select("doc_id", "source", F.col("__epoch").alias("epoch"), F.col("__block").alias("block"), F.col("__place").alias("place"), F.col("__tokens").alias("n_tokens"), F.col("__weight").alias("weight"))
