"""Block-codec operators that are relational: quantiser lookups, filter masks, edge directions, colour caches and
distance codes. Lookups join small tables of fixed size; neighbours are window lags or columns of one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.integer import clip3, div

# VP8 quantiser steps by index 0 to 127.
# fmt: off
DC_STEPS = (
    4, 5, 6, 7, 8, 9, 10, 10, 11, 12, 13, 14, 15, 16, 17, 17, 18, 19, 20, 20, 21, 21, 22, 22, 23, 23, 24, 25, 25, 26, 27, 28,
    29, 30, 31, 32, 33, 34, 35, 36, 37, 37, 38, 39, 40, 41, 42, 43, 44, 45, 46, 46, 47, 48, 49, 50, 51, 52, 53, 54, 55, 56, 57, 58,
    59, 60, 61, 62, 63, 64, 65, 66, 67, 68, 69, 70, 71, 72, 73, 74, 75, 76, 76, 77, 78, 79, 80, 81, 82, 83, 84, 85, 86, 87, 88, 89,
    91, 93, 95, 96, 98, 100, 101, 102, 104, 106, 108, 110, 112, 114, 116, 118, 122, 124, 126, 128, 130, 132, 134, 136, 138, 140, 143, 145, 148, 151, 154, 157,
)
AC_STEPS = (
    4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, 33, 34, 35,
    36, 37, 38, 39, 40, 41, 42, 43, 44, 45, 46, 47, 48, 49, 50, 51, 52, 53, 54, 55, 56, 57, 58, 60, 62, 64, 66, 68, 70, 72, 74, 76,
    78, 80, 82, 84, 86, 88, 90, 92, 94, 96, 98, 100, 102, 104, 106, 108, 110, 112, 114, 116, 119, 122, 125, 128, 131, 134, 137, 140, 143, 146, 149, 152,
    155, 158, 161, 164, 167, 170, 173, 177, 181, 185, 189, 193, 197, 201, 205, 209, 213, 217, 221, 225, 229, 234, 239, 245, 249, 254, 259, 264, 269, 274, 279, 284,
)
# fmt: on


def quantiser_steps(spark: SparkSession) -> DataFrame:
    """(q, dc, ac): 128 rows."""
    rows = [(k, a, b) for k, (a, b) in enumerate(zip(DC_STEPS, AC_STEPS, strict=True))]
    return spark.createDataFrame(rows, "q int, dc int, ac int")


def _step(q: Column, steps: tuple[int, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in steps]), (clip3(0, 127, q) + 1).cast("int"))


def quantiser_factors(base: Column, deltas: dict[str, Column]) -> dict[str, Column]:
    """The six factors of a segment from its base index and the deltas y_dc, y2_dc, y2_ac, uv_dc, uv_ac."""
    dc, ac = (lambda name: _step(base + deltas[name], DC_STEPS)), (lambda name: _step(base + deltas[name], AC_STEPS))
    return {
        "y1_dc": dc("y_dc"), "y1_ac": _step(base, AC_STEPS), "y2_dc": dc("y2_dc") * 2, "y2_ac": F.greatest(div(ac("y2_ac") * 155, 100), F.lit(8)).cast("int"),
        "uv_dc": F.least(dc("uv_dc"), F.lit(132)), "uv_ac": ac("uv_ac"),
    }


def segment_index(base: Column, adjust: Column, absolute: Column, enabled: Column, top: int = 127) -> Column:
    """A segment's quantiser index (or, with ``top=63``, its filter level)."""
    return F.when(~enabled, base).otherwise(clip3(0, top, F.when(absolute, adjust).otherwise(base + adjust)))


def interior_limit(level: Column, sharpness: Column) -> Column:
    halved = F.when(sharpness > 4, div(level, 4)).when(sharpness > 0, div(level, 2)).otherwise(level)
    return F.greatest(F.when(sharpness > 0, F.least(halved, F.lit(9) - sharpness)).otherwise(halved), F.lit(1)).cast("int")


def edge_variance_threshold(level: Column) -> Column:
    return F.when(level >= 40, 2).when(level >= 15, 1).otherwise(0)


def filter_edge(taps: Sequence[Column], interior: Column, edge: Column) -> Column:
    """Whether the edge between the fourth and fifth of eight samples is smoothed."""
    gap = lambda a, b: F.abs(taps[a] - taps[b])
    fine = gap(3, 4) * 2 + div(gap(2, 5), 2) <= edge
    for a in (0, 1, 2, 4, 5, 6):
        fine = fine & (gap(a, a + 1) <= interior)
    return fine


def high_variance(taps: Sequence[Column], threshold: Column) -> Column:
    return (F.abs(taps[2] - taps[3]) > threshold) | (F.abs(taps[5] - taps[4]) > threshold)


def edge_masks(samples: DataFrame, width: int, at: int, interior: Column, edge: Column, threshold: Column) -> DataFrame:
    """The masks of a vertical edge left of column ``at`` in each row: (img, y, smooth, variance). ``samples``: img, p, v."""
    x = F.col("p") % width
    rows = samples.groupBy("img", div(F.col("p"), width).alias("y")).agg(*[F.max(F.when(x == at - 4 + k, F.col("v"))).alias(f"t{k}") for k in range(8)])
    taps = [F.col(f"t{k}") for k in range(8)]
    return rows.select("img", "y", filter_edge(taps, interior, edge).alias("smooth"), high_variance(taps, threshold).alias("variance"))


def _lines(x: Column, y: Column) -> list[Column]:
    """The line of each of eight directions that a place of an 8 x 8 block is on."""
    half = lambda v: div(v, 2)
    return [y + x, y + half(x), y, y + 3 - half(x), y + 7 - x, x + 3 - half(y), x, x + half(y)]


def block_directions(samples: DataFrame, width: int) -> DataFrame:
    """The dominant direction of each 8 x 8 block and how far its cost stands out: (img, bx, by, direction, variance).

    Costs are sums of squares of line sums, each weighted by 840 over the line's length. Lines are counted as array
    elements of one aggregate a block, so a pixel stays one row.
    """
    x, y = F.col("p") % width, div(F.col("p"), width)
    cells = samples.select("img", div(x, 8).alias("bx"), div(y, 8).alias("by"), (x % 8).alias("x"), (y % 8).alias("y"), (F.col("v") - 128).cast("long").alias("v"))
    kinds = [(d, line) for d in range(8) for line in range(15 if d in (0, 4) else 8 if d in (2, 6) else 11)]
    lines = _lines(F.col("x"), F.col("y"))
    sums = cells.groupBy("img", "bx", "by").agg(*[F.sum(F.when(lines[d] == k, F.col("v")).otherwise(0)).alias(f"s{d}_{k}") for d, k in kinds])

    def length(d: int, k: int) -> int:
        if d in (2, 6):
            return 8
        if d in (0, 4):
            return min(k + 1, 15 - k)
        return min(2 * (k + 1), 8, 2 * (11 - k))

    costs = [sum((F.col(f"s{e}_{k}") * F.col(f"s{e}_{k}") * (840 // length(e, k)) for e, k in kinds if e == d), F.lit(0).cast("long")) for d in range(8)]
    costed = sums.select("img", "bx", "by", F.array(*costs).alias("costs"))
    best = F.array_max("costs")
    direction = F.when(best > 0, F.array_position("costs", best) - 1).otherwise(0).cast("int")
    other = F.element_at("costs", (direction + 4) % 8 + 1)
    return costed.select("img", "bx", "by", direction.alias("direction"), div(best - other, 1024).alias("variance"))


CACHE_MULTIPLIER = 0x1E35A7BD


def cache_hits(pixels: DataFrame, bits: int) -> DataFrame:
    """Whether a colour cache of 2^bits slots holds each pixel when it comes: (img, p, slot, hit). The last pixel of
    the same slot is what it holds, black transparent before any. ``pixels``: img, p, colour."""
    if not 1 <= bits <= 11:
        raise ValueError("a cache has 1 to 11 bits")
    slot = F.shiftright((F.col("colour") * CACHE_MULTIPLIER).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), 32 - bits)
    before = F.lag("colour", 1, 0).over(Window.partitionBy("img", "slot").orderBy("p"))
    return pixels.withColumn("slot", slot.cast("int")).select("img", "p", "slot", (before == F.col("colour")).alias("hit"))


# The offsets (x, y) of short distance codes, in the order of the codes.
# fmt: off
OFFSETS = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1),
    (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4),
    (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6),
    (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5),
    (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
# fmt: on


def neighbourhood() -> tuple[tuple[int, int], ...]:
    """The 120 offsets of short distance codes."""
    return OFFSETS


def linear_preview(samples: DataFrame, width: int, planes: int, black: int, white: int) -> DataFrame:
    """2 x 2 box means of the first three planes, scaled to eight bits: (img, px, py, channel, v). ``samples``: img, p
    (pixel), plane, v; a raw image of fewer planes repeats its last."""
    x, y = F.col("p") % width, div(F.col("p"), width)
    means = samples.groupBy("img", div(x, 2).alias("px"), div(y, 2).alias("py"), "plane").agg(div(F.sum("v"), F.count("*")).alias("m"))
    scaled = F.least(div(F.greatest(F.col("m") - black, F.lit(0)) * 255, max(white - black, 1)), F.lit(255)).cast("int")
    channels = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.lit(min(c, planes - 1)).alias("from")) for c in range(3)]))
    return means.withColumn("c", channels).where(F.col("plane") == F.col("c.from")).select("img", "px", "py", F.col("c.channel").alias("channel"), scaled.alias("v"))


def downscale_rows(samples: DataFrame, width: int, target: int) -> DataFrame:
    """Rows narrowed to ``target`` samples by box means: (img, y, x, v). Box b holds the samples from floor(b width /
    target) to before floor((b + 1) width / target), so each sample is in one box: the last that begins at or before it."""
    box = div((F.col("p") % width + 1) * target - 1, width)
    parts = samples.select("img", div(F.col("p"), width).alias("y"), box.alias("x"), "v")
    return parts.groupBy("img", "y", "x").agg(div(F.sum("v"), F.count("*")).cast("int").alias("v"))


def rational(x: Column, signed: bool = True) -> Column:
    """A double as millionths, rounded half away from zero; below zero an unsigned one is 0."""
    value = x if signed else F.greatest(x, F.lit(0.0))
    return F.struct(F.round(value * 1_000_000).cast("long").alias("num"), F.lit(1_000_000).alias("den"))


def merge_palettes(above: Column, left: Column) -> Column:
    """Two sorted palettes as one without repetitions."""
    return F.array_sort(F.array_distinct(F.concat(above, left)))


def modal_groups(symbols: DataFrame) -> DataFrame:
    """A group for each block of an image by its most frequent symbol (the least of equals), numbered by the first
    block that has it: (img, block, symbol, grp). ``symbols``: img, block, symbol."""
    counts = symbols.groupBy("img", "block", "symbol").agg(F.count("*").alias("n"))
    modal = counts.groupBy("img", "block").agg(F.min(F.struct((-F.col("n")).alias("n"), "symbol"))["symbol"].alias("symbol"))
    first = modal.withColumn("first", F.min("block").over(Window.partitionBy("img", "symbol")))
    return first.withColumn("grp", F.dense_rank().over(Window.partitionBy("img").orderBy("first")) - 1).select("img", "block", "symbol", "grp")
