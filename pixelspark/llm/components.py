"""Connected components of a graph of any size, by alternating large-star and small-star rounds.

Each round is a groupBy that is combined before its shuffle and a join whose skewed side Spark splits, and its edges
are written to the shared folder, so neither a hub nor a lost executor matters. Nothing goes to the driver but a
checksum of the edges.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _checksum(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row.n, row.x or 0


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v long) to (u, root): every node that is no root, with the least node of its component."""
    now = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = None
    while (seen := _checksum(now)) != last:
        last = seen
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that the join deals both its sides out anew and Spark can split a hub's edges.
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        now = staged(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        least = staged(now.groupBy("u").agg(F.min("v").alias("m")), "least")
        kept = now.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        oriented = kept.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        now = staged(oriented.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return now.select("u", F.col("v").alias("root"))


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same in memory for the edges of one batch: each node that is no root, and its root."""
    nodes, both = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = both[: len(u)], both[len(u) :]
    label = np.arange(len(nodes))
    while True:
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        before = label.copy()
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        label = label[label]
        if (label == before).all():
            break
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[other], nodes[label[other]]
