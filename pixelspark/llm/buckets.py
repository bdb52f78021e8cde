"""Links between fingerprints that meet under a key, whatever the size of a key's bucket.

A fingerprint is one or more words of 64 bits, signed longs in the frames. Buckets are read in key order and searched
in memory, small ones place by place, others breadth first, so that what is linked already is compared no more. A
bucket that fills ``MOST_ROWS`` rows isn't searched there: its rows go out in blocks, and each pair of its blocks is
work of its own, so no task holds more than two blocks. Links come as forests, never as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, pieces, release_memory, staged
from .components import forest

#: Rows that one task gathers before it searches their buckets, and so about the most of a block.
MOST_ROWS = 1 << 16
#: Buckets of more rows are searched breadth first.
SMALL = 32
#: Roles of a row under its key: it is filed, it looks up, or both. Rows meet if one is filed and the other looks up.
FILED, LOOKS, BOTH = 1, 2, 3


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of words."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def reach(prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (row numbers) of a spanning forest of the rows that differ in ``max_bits`` or less."""
    us, vs = [], []
    left, rest = np.arange(len(prints)), prints
    while len(left) > 1:
        waiting, left, rest = [int(left[0])], left[1:], rest[1:]
        while waiting and len(left):
            one = waiting.pop()
            near = _apart(rest, prints[one]) <= max_bits
            if near.any():
                hit = left[near]
                us.append(np.full(len(hit), one))
                vs.append(hit)
                waiting += hit.tolist()
                left, rest = left[~near], rest[~near]
    none = np.zeros(0, np.int64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (none, none)


def bucket_links(keys: np.ndarray, roles: np.ndarray, prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (row numbers) within whole buckets, sorted by key; rows of equal prints need no link."""
    none = np.zeros(0, np.int64)
    if len(keys) < 2:
        return none, none
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    us, vs = [none], [none]
    ends = np.repeat(starts + sizes, sizes)
    at, step = np.flatnonzero(np.repeat(sizes <= SMALL, sizes)), 1
    while True:
        at = at[at + step < ends[at]]
        if not len(at):
            break
        meet = at[(roles[at] | roles[at + step]) == BOTH]
        bits = _apart(prints[meet], prints[meet + step])
        near = meet[(bits <= max_bits) & (bits > 0)]
        us.append(near)
        vs.append(near + step)
        step += 1
    for k in np.flatnonzero(sizes > SMALL).tolist():
        first, last = starts[k], starts[k] + sizes[k]
        rows = first + np.unique(prints[first:last], axis=0, return_index=True)[1]
        u, v = reach(prints[rows], max_bits)
        us.append(rows[u])
        vs.append(rows[v])
    return np.concatenate(us), np.concatenate(vs)


def links(keyed: DataFrame, words: int, max_bits: int) -> DataFrame:
    """``keyed`` (key long, role byte, w0 .. long) to links (u0 .., v0 ..) between prints that meet under a key and
    differ in ``max_bits`` or less: between any two linked prints of a bucket there is a way over its links. Equal
    prints get none. An empty table gives no links."""
    u, v = [f"u{k}" for k in range(words)], [f"v{k}" for k in range(words)]
    longs = lambda names: ", ".join(f"{x} long" for x in names)

    def signed(prints: np.ndarray) -> list[pa.Array]:
        return [pa.array(np.ascontiguousarray(prints[:, k]).view(np.int64)) for k in range(words)]

    def least(parts: list[np.ndarray]) -> list[np.ndarray]:
        """Links (both ends in a row), each node's to the least it reaches: what buckets have in common is one link."""
        both = np.concatenate(parts)
        if not len(both):
            return [both]
        ends = np.concatenate([both[:, :words], both[:, words:]])
        order = np.lexsort(ends.T[::-1])
        ends = ends[order]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(np.r_[False, (ends[1:] != ends[:-1]).any(axis=1)])
        first = np.searchsorted(number[order], np.arange(number.max() + 1))
        a, b = forest(number[: len(both)], number[len(both) :])
        return [np.concatenate([ends[first[a]], ends[first[b]]], axis=1)]

    def found(keys: np.ndarray, roles: np.ndarray, prints: np.ndarray) -> np.ndarray:
        a, b = bucket_links(keys, roles, prints, max_bits)
        return np.concatenate([prints[a], prints[b]], axis=1)

    def read(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, role, *rest = (batch.column(x).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(x).to_numpy() for x in ("key", "role", *u))
        return key, role, np.stack(rest, axis=1).view(np.uint64)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*u, *v, "key", "block", "role"]
        held: list[tuple[np.ndarray, ...]] = []
        size, over_key, blocks = 0, None, 0

        def joined() -> tuple[np.ndarray, ...]:
            return tuple(np.concatenate(x) for x in zip(*held, strict=True))

        def block(keys: np.ndarray, roles: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
            gone = pa.nulls(len(keys), pa.int64())
            return pa.RecordBatch.from_arrays([*signed(prints), *[gone] * words, pa.array(keys), pa.array(np.full(len(keys), blocks)), pa.array(roles)], names)

        gathered: list[np.ndarray] = []

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal gathered
            if gathered and (last or sum(map(len, gathered)) >= MOST_ROWS):
                gathered = least(gathered)
                if last or len(gathered[0]) >= MOST_ROWS:
                    both, gathered = gathered[0], []
                    n = len(both)
                    yield pa.RecordBatch.from_arrays([*signed(both[:, :words]), *signed(both[:, words:]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int8())], names)

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            """Searches whole buckets and keeps the last key's rows, which may go on. Of a key that has filled all
            that is held, the rows go out in blocks to its end."""
            nonlocal held, size, over_key, blocks
            keys, roles, prints = joined()
            end = int(np.searchsorted(keys, keys[-1])) if not last else len(keys)
            if over_key is None and end == 0:
                over_key, blocks = keys[-1], 0
            if over_key is not None:
                gone = int(np.searchsorted(keys, over_key, side="right"))
                if gone:
                    yield block(keys[:gone], roles[:gone], prints[:gone])
                    blocks += 1
                if gone < len(keys):
                    over_key = None
                keys, roles, prints, end = keys[gone:], roles[gone:], prints[gone:], max(0, end - gone)
            if end:
                gathered.append(found(keys[:end], roles[:end], prints[:end]))
                yield from out(False)
            held = [(keys[end:], roles[end:], prints[end:])] if end < len(keys) else []
            size = len(keys) - end

        for batch in pieces(batches, max(1, MOST_ROWS // 4)):
            held.append(read(batch))
            size += batch.num_rows
            if size >= MOST_ROWS:
                yield from flush(False)
        if held:
            yield from flush(True)
        yield from out(True)
        held.clear()
        release_memory()

    def pair(group: pa.Table) -> pa.Table:
        _, roles, prints = read(group)
        both = least([found(np.zeros(len(roles), np.int64), roles, prints)])[0]
        return pa.Table.from_arrays(signed(both[:, :words]) + signed(both[:, words:]), [*u, *v])

    spark = keyed.sparkSession
    dealt = keyed.select("key", "role", *[F.col(f"w{k}").alias(u[k]) for k in range(words)]).repartition(partitions(spark), "key").sortWithinPartitions("key")
    # What several keys have found is one row, and the few rows go to a file or two and not to one a task.
    first = staged(dealt.mapInArrow(search, f"{longs(u + v)}, key long, block long, role byte").distinct(), "links")
    small = first.where("key is null").select(*u, *v)
    large = first.where("key is not null").select("key", "block", "role", *u)
    if large.isEmpty():
        return small
    blocks = staged(large.groupBy("key").agg((F.max("block") + 1).alias("blocks")), "large-buckets")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    units = large.join(blocks, "key").select("key", "block", "role", *u, other)
    units = units.select("key", "role", *u, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return small.unionAll(units.groupBy("key", "i", "j").applyInArrow(pair, longs(u + v)))
