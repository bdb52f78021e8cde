"""Neighbour operators: scanline filters, predictors, run lengths and colour changes.

Rows carry an image id and the place of a sample in it. A window is partitioned by image alone and ordered by place, so
one shuffle and one sort serve every neighbour: left, above and the corner are lags of fixed distance. No image is
larger than a decoder's limit of 64 MiB, which bounds a window's partition; many images share the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.integer import div, paeth, wrap8

FILTERS = ("none", "sub", "up", "average", "paeth")


def with_neighbours(samples: DataFrame, row_bytes: int, bpp: int) -> DataFrame:
    """``samples`` (img, p, v: the byte at place p of row-major rows) with y, i and the neighbours a (left), b (above)
    and c (corner); 0 outside the image."""
    by_place = Window.partitionBy("img").orderBy("p")
    inside = F.col("p") % row_bytes >= bpp
    return samples.withColumns(
        {
            "y": div(F.col("p"), row_bytes),
            "i": F.col("p") % row_bytes,
            "a": F.when(inside, F.lag("v", bpp, 0).over(by_place)).otherwise(0),
            "b": F.lag("v", row_bytes, 0).over(by_place),
            "c": F.when(inside, F.lag("v", row_bytes + bpp, 0).over(by_place)).otherwise(0),
        }
    )


def filter_residuals(neighbours: DataFrame) -> DataFrame:
    """The residual of each of the five scanline filters: f0 to f4."""
    v, a, b, c = (F.col(x) for x in "vabc")
    guesses = [F.lit(0), a, b, div(a + b, 2), paeth(a, b, c)]
    return neighbours.withColumns({f"f{k}": wrap8(v - guess).cast("int") for k, guess in enumerate(guesses)})


def _cost(x: Column) -> Column:
    return F.least(x, (F.lit(256) - x) % 256)


def choose_filters(samples: DataFrame, row_bytes: int, bpp: int) -> DataFrame:
    """The filter of least sum of wrapped absolutes for each scanline, the first of equals: (img, y, filter, score)."""
    costs = filter_residuals(with_neighbours(samples, row_bytes, bpp)).groupBy("img", "y").agg(*[F.sum(_cost(F.col(f"f{k}"))).alias(f"s{k}") for k in range(5)])
    best = F.array_min(F.array(*[F.struct(F.col(f"s{k}").alias("score"), F.lit(k).alias("filter")) for k in range(5)]))
    return costs.select("img", "y", best["filter"].alias("filter"), best["score"].alias("score"))


def predictor_forward(samples: DataFrame, row_samples: int, spp: int) -> DataFrame:
    """Horizontal differencing of each row: (img, p, d)."""
    before = F.lag("v", spp, 0).over(Window.partitionBy("img").orderBy("p"))
    return samples.select("img", "p", wrap8(F.col("v") - F.when(F.col("p") % row_samples >= spp, before).otherwise(0)).cast("int").alias("d"))


def predictor_reverse(differences: DataFrame, row_samples: int, spp: int) -> DataFrame:
    """Its inverse, a running sum of each row and component: (img, p, d, v). Rows that a shuffle has dealt by image
    already, as those of ``predictor_forward``, aren't shuffled again."""
    own = Window.partitionBy("img", div(F.col("p"), row_samples), F.col("p") % row_samples % spp).orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    return differences.select("img", "p", "d", wrap8(F.sum("d").over(own)).cast("int").alias("v"))


def alpha_residuals(samples: DataFrame, width: int) -> DataFrame:
    """Residuals of the four alpha filters (none, horizontal, vertical, gradient): h0 to h3 with x and y."""
    by_place = Window.partitionBy("img").orderBy("p")
    x, y, v = F.col("p") % width, div(F.col("p"), width), F.col("v")
    left, up, corner = F.lag("v", 1, 0).over(by_place), F.lag("v", width, 0).over(by_place), F.lag("v", width + 1, 0).over(by_place)
    first = (x == 0) & (y == 0)
    gradient = F.greatest(F.least(left + up - corner, F.lit(255)), F.lit(0))
    guesses = [
        F.lit(0),
        F.when(first, 0).when(x > 0, left).otherwise(up),
        F.when(first, 0).when(y > 0, up).otherwise(left),
        F.when(first, 0).when(x == 0, up).when(y == 0, left).otherwise(gradient),
    ]
    return samples.withColumns({"x": x, "y": y} | {f"h{k}": wrap8(v - g).cast("int") for k, g in enumerate(guesses)})


def choose_alpha_filter(samples: DataFrame, width: int) -> DataFrame:
    """(img, filter, score) by least sum of wrapped absolutes over the image, the first of equals."""
    costs = alpha_residuals(samples, width).groupBy("img").agg(*[F.sum(_cost(F.col(f"h{k}"))).alias(f"s{k}") for k in range(4)])
    best = F.array_min(F.array(*[F.struct(F.col(f"s{k}").alias("score"), F.lit(k).alias("filter")) for k in range(4)]))
    return costs.select("img", best["filter"].alias("filter"), best["score"].alias("score"))


def runs(samples: DataFrame, row_samples: int) -> DataFrame:
    """Runs of equal samples in each row: (img, y, start, v, len), by gaps and islands."""
    row = Window.partitionBy("img").orderBy("p")
    change = F.when((F.col("p") % row_samples == 0) | (F.col("v") != F.lag("v").over(row)), 1).otherwise(0)
    marked = samples.withColumn("change", F.coalesce(change, F.lit(1))).withColumn("run", F.sum("change").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    found = marked.groupBy("img", "run").agg(F.min("p").alias("p"), F.first("v").alias("v"), F.count("*").alias("len"))
    return found.select("img", div(F.col("p"), row_samples).alias("y"), (F.col("p") % row_samples).alias("start"), "v", "len")


def changing_elements(bits: DataFrame, width: int) -> DataFrame:
    """Places of each row where the colour changes, white (0) before the row: (img, y, x, v)."""
    before = F.when(F.col("p") % width == 0, 0).otherwise(F.lag("v").over(Window.partitionBy("img").orderBy("p")))
    marked = bits.withColumn("before", before).where("v <> before")
    return marked.select("img", div(F.col("p"), width).alias("y"), (F.col("p") % width).alias("x"), "v")


def reference_changes(changes: DataFrame, width: int) -> DataFrame:
    """For each change of a row, the next change of the row above, to its right, and of the same new colour (b1), as
    Group 4 codes it; ``width`` where there is none: (img, y, x, v, b1). An as-of join as one window over the merged
    rows, from the right."""
    own = changes.select("img", "y", "x", "v", F.lit(0).alias("above"))
    above = changes.select("img", (F.col("y") + 1).alias("y"), "x", "v", F.lit(1).alias("above"))
    after = Window.partitionBy("img", "y", "v").orderBy(F.desc("x"), "above").rowsBetween(Window.unboundedPreceding, -1)
    both = own.unionAll(above).withColumn("b1", F.min(F.when(F.col("above") == 1, F.col("x"))).over(after))
    return both.where("above = 0").select("img", "y", "x", "v", F.coalesce("b1", F.lit(width)).alias("b1"))
