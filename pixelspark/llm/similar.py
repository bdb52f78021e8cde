"""Near copies: SimHash fingerprints wide enough for a Jaccard similarity, found by Golay-code keys, verified exactly.

A link is a Jaccard similarity of the sets of word shingles of ``SIMILARITY`` or more. Such sets differ in up to 15 % of
the bits of a SimHash, about ten of 64, which is beyond the three bits that the keys of ``simhash`` guarantee. So the
fingerprint here is wider, and its segments are decoded by how far each bit's count is from the middle, not by the bit
alone: of ``SEGMENTS`` segments of 23 bits, each gives its ``NEAR`` likeliest codewords of the Golay code. Errors spread
over the segments, so that by the pigeonhole a pair has ``TOGETHER`` segments with few of them, and shares a key: the
codewords of that many segments. By simulation of a pair at 0.8 the keys meet 99.9 times in a hundred; one that is more
alike misses more rarely still. Further ``CHECK_WORDS`` words of the fingerprint, which no key uses, stand for a set in
the buckets: what differs in more than ``MOST_BITS`` of them (four standard deviations from a pair at 0.8) is no candidate.

Candidates make groups, passed on as forests. The texts of a group come together in blocks of bounded size, with a few
*anchors* of the group in each, and are searched for links breadth first, so that a text is compared only with those
that no link has reached yet. Where a group has several blocks, what is not in its largest class after that is compared
with all its blocks, so no link between different sets is lost, and what is alike is never compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import BOTH, links
from .common import flagged, partitions, pieces, release_memory, staged
from .components import components
from .simhash import SEED, _golay, keep_first, shingle_hashes

WORDS = 5
SIMILARITY = 0.8
#: Segments of the Golay code's 23 bits, codewords a segment, and segments a key.
SEGMENTS, NEAR, TOGETHER = 6, 4, 2
#: Words of the fingerprint: those that the segments take their bits from, and those that verify.
KEY_WORDS, CHECK_WORDS = 3, 2
#: Most differing bits of the verifying words.
MOST_BITS = 36
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16
#: Sets and bytes of their shingles in a block of a candidate group, and about how many anchors a group has.
BLOCK_SETS, BLOCK_BYTES, ANCHORS = 512, 1 << 22, 8
_BYTES = np.uint64(0x0101010101010101)
_FACTORS = np.array([1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


@cache
def _codewords() -> np.ndarray:
    """(23, 4096): the codewords with bits as -1 and 1."""
    values = np.arange(4096) << 11
    words = values ^ _golay()[0]
    return np.ascontiguousarray(((words >> np.arange(23)[:, None]) & 1) * 2 - 1, np.float32)


def shingle_set(raw: bytes | None, words: int) -> np.ndarray:
    """The different shingles' XXH64, in order."""
    return np.unique(np.array(shingle_hashes(raw, words), np.uint64))


def bit_counts(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, 64 x words): for each bit, the ones less the zeros over the shingles of each set. No set is empty."""
    words = KEY_WORDS + CHECK_WORDS
    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    # Runs of up to 255 shingles of one set, so that eight counters share a word.
    runs = -(-sizes // 255)
    first = np.repeat(np.cumsum(sizes) - sizes, runs) + 255 * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
    ends = np.r_[first[1:], len(flat)]
    ones = np.empty((len(first), words, 8, 8), np.uint8)
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(ends, first[at] + BLOCK, side="right")))
        part = flat[first[at] : ends[to - 1]]
        for w in range(words):
            mixed = part if w == 0 else (part ^ (part >> np.uint64(29))) * _FACTORS[w]
            mixed = mixed if w == 0 else (mixed ^ (mixed >> np.uint64(32))) * _FACTORS[1 + w % 4]
            mixed = mixed if w == 0 else mixed ^ (mixed >> np.uint64(29))
            for k in range(8):
                sums = np.add.reduceat((mixed >> np.uint64(k)) & _BYTES, first[at:to] - first[at])
                ones[at:to, w, k] = sums.view(np.uint8).reshape(-1, 8)
        at = to
    total = np.add.reduceat(ones.reshape(len(first), -1).astype(np.int32), np.cumsum(runs) - runs, axis=0)
    return 2 * total - sizes[:, None].astype(np.int32)


def near_codes(counts: np.ndarray) -> np.ndarray:
    """(sets, segments, NEAR): the likeliest codewords of each segment, by their agreement with the counts."""
    part = counts[:, : SEGMENTS * 23].reshape(-1, 23).astype(np.float32)
    out = np.empty((len(part), NEAR), np.int64)
    for at in range(0, len(part), 512):
        agree = part[at : at + 512] @ _codewords()
        rows = np.arange(len(agree))
        for k in range(NEAR):
            out[at : at + 512, k] = best = agree.argmax(axis=1)
            agree[rows, best] = -np.inf
    return out.reshape(-1, SEGMENTS, NEAR)


def check_words(counts: np.ndarray) -> np.ndarray:
    """(sets, CHECK_WORDS) words: a bit is 1 if set in over half the shingles."""
    bits = counts[:, KEY_WORDS * 64 :] > 0
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").astype(np.uint64)


def segment_keys(codes: np.ndarray) -> np.ndarray:
    """(sets, keys): the codewords of each choice of ``TOGETHER`` segments."""
    out = []
    for kind, which in enumerate(combinations(range(SEGMENTS), TOGETHER)):
        for near in product(range(NEAR), repeat=TOGETHER):
            key = np.full(len(codes), kind, np.int64)
            for segment, k in zip(which, near, strict=True):
                key = key << 12 | codes[:, segment, k]
            out.append(key)
    return np.stack(out, axis=1)


def set_hash(shingles: np.ndarray) -> int:
    """Names a set of shingles, as a signed long."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).astype(np.int64))


def linked(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """The number of the first set that each of ``sets`` (sorted, not empty) is reached from over links."""
    sizes = np.array([len(x) for x in sets])
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    root = np.full(len(sets), -1)
    marks = np.zeros(len(names), bool)

    def gather(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([flat[starts[k] : starts[k] + sizes[k]] for k in which]), np.cumsum(sizes[which]) - sizes[which]

    left = np.arange(len(sets))
    values, at = gather(left)
    for first in range(len(sets)):
        if root[first] >= 0:
            continue
        root[first] = first
        waiting = [first]
        while waiting:
            one = waiting.pop()
            if (root[left] >= 0).sum() * 2 > len(left):
                left = left[root[left] < 0]
                if not len(left):
                    return root
                values, at = gather(left)
            own = flat[starts[one] : starts[one] + sizes[one]]
            marks[own] = True
            shared = np.add.reduceat(marks[values], at, dtype=np.int64)
            marks[own] = False
            near = (shared / (sizes[left] + sizes[one] - shared) >= similarity) & (root[left] < 0)
            root[left[near]] = first
            waiting += left[near].tolist()
    return root


def _verified(sets: DataFrame, similarity: float) -> DataFrame:
    """(node, root) of the groups of ``sets`` (group, node, shingles), the nodes that others link to named as roots.

    Blocks are dealt by the node, so how the rows arrive doesn't matter.
    """

    def link(group: pa.Table) -> pa.Table:
        nodes, first = np.unique(group.column("node").to_numpy(), return_index=True)
        raw = group.column("shingles")
        root = linked([np.frombuffer(raw[int(k)].as_py(), np.uint64) for k in first], similarity)
        release_memory()
        return pa.table({"node": nodes, "root": nodes[root]})

    size = F.greatest(F.count("*") / BLOCK_SETS, F.sum(F.octet_length("shingles")) / BLOCK_BYTES)
    many = staged(sets.groupBy("group").agg(F.ceil(size).alias("blocks"), F.count("*").alias("n")).where("blocks > 1"), "large-groups")
    if many.isEmpty():
        return staged(sets.groupBy("group").applyInArrow(link, "node long, root long"), "similar")

    dealt = sets.join(many, "group", "left").withColumns({"blocks": F.coalesce("blocks", F.lit(1)), "n": F.coalesce("n", F.lit(1))})
    block = lambda column, salt: F.expr(f"pmod(xxhash64(node, {salt}), {column})")
    all_blocks = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    # A node is an anchor by its hash alone; anchors go to all blocks of their group.
    anchor = F.expr(f"pmod(xxhash64(node, 2), n) < {ANCHORS}")
    rows = dealt.withColumn("to", F.when((F.col("blocks") > 1) & anchor, all_blocks).otherwise(F.array(block("blocks", 1))))
    near = rows.select("group", "node", "shingles", F.explode("to").alias("block"))
    once = staged(near.groupBy("group", "block").applyInArrow(link, "node long, root long"), "similar-in-blocks")
    edges = once.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    reached = staged(components(edges), "similar-classes").withColumnRenamed("u", "node")

    # In groups of several blocks: what isn't of the group's largest class against all its blocks.
    classed = sets.select("group", "node").join(many, "group").join(reached, "node", "left").select("group", "node", "blocks", F.coalesce("root", "node").alias("class"))
    classed = staged(classed, "classes-of-large-groups")
    largest = classed.groupBy("group", "class").agg(F.count("*").alias("size")).groupBy("group").agg(F.max_by("class", F.struct("size", "class")).alias("main"), F.max("size").alias("size"), F.sum("size").alias("n"))
    parts = largest.where("size < n").select("group", "main", F.ceil((F.col("n") - F.col("size")) / BLOCK_SETS).alias("minors"))
    parts = staged(parts, "groups-to-compare")
    if parts.isEmpty():
        return reached
    asked = classed.join(parts, "group").select("group", "node", "blocks", "minors", (F.col("class") != F.col("main")).alias("minor"))
    asked = asked.join(sets, ["group", "node"])
    against = asked.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("minors") - 1))).withColumn("j", block("blocks", 1))
    own = asked.where("minor").withColumn("i", block("minors", 3)).withColumn("j", F.explode(all_blocks))
    units = own.unionByName(against).select("group", "i", "j", "node", "shingles")
    more = staged(units.groupBy("group", "i", "j").applyInArrow(link, "node long, root long"), "similar-across-blocks")
    edges = edges.unionAll(more.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    return components(staged(edges, "similar-links")).withColumnRenamed("u", "node")


def near_groups(docs: DataFrame, *, words: int = WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id, text_hash and root, which the documents of a group share.

    Documents link when the sets of their shingles are ``similarity`` alike or more; texts without words, null ones
    included, link with each other. The keys are set for similarities of 0.8 and more. Repeated rows each keep their
    row; null ids are ids like others; an empty table gives an empty result; other columns aren't read.

    Two sets that have nothing in common meet under some key 1.4 times in ten thousand by chance and are told apart by
    their words. So that this stays small beside the keys themselves, corpora of more than some ten million different
    texts want keys of three segments (``TOGETHER``).
    """
    if not SIMILARITY <= similarity <= 1:
        raise ValueError(f"the keys find pairs that are {SIMILARITY} alike or more")
    id_type = docs.schema[id_col].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 128):
            sets = [shingle_set(x, words) for x in batch.column(2).to_pylist()]
            some = [k for k, x in enumerate(sets) if len(x)]
            checks, codes = np.zeros((len(sets), CHECK_WORDS), np.uint64), [None] * len(sets)
            if some:
                counts = bit_counts([sets[k] for k in some])
                checks[some] = check_words(counts)
                for k, own in zip(some, near_codes(counts).astype(np.int16).reshape(len(some), -1), strict=True):
                    codes[k] = own
            checks = checks.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([set_hash(x) for x in sets], pa.int64()), pa.array(checks[:, 0].copy()), pa.array(checks[:, 1].copy()), pa.array(codes, pa.list_(pa.int16()))],
                ["id", "text_hash", "node", "w0", "w1", "codes"],
            )

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2048):
            keys = segment_keys(batch.column(2).flatten().to_numpy().reshape(-1, SEGMENTS, NEAR).astype(np.int64))
            w0, w1 = (np.repeat(batch.column(k).to_numpy(), keys.shape[1]) for k in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.full(keys.size, BOTH, np.int8)), pa.array(w0), pa.array(w1)], ["key", "role", "w0", "w1"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = [shingle_set(x, words).tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], ["group", "node", "shingles"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text_col}`").alias("text_hash"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    marked = staged(rows.mapInArrow(describe, f"id {id_type}, text_hash long, node long, w0 long, w1 long, codes array<short>"), "wide-prints")
    # Equal sets are one node, and equal prints one row under each key, so that exact copies meet nowhere.
    own = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")).alias("own")
    apart = staged(marked.where("codes is not null").groupBy("node").agg(own, F.first("w0").alias("w0"), F.first("w1").alias("w1"), F.first("codes").alias("codes")).withColumn("print", F.xxhash64("w0", "w1")), "shingle-sets")
    keyed = apart.select("w0", "w1", "codes").repartition(partitions(docs.sparkSession), "w0").mapInArrow(spread, "key long, role byte, w0 long, w1 long")
    found = links(keyed, 2, MOST_BITS).select(F.xxhash64("u0", "u1").alias("u"), F.xxhash64("v0", "v1").alias("v"))
    roots = staged(components(staged(found, "candidates")), "candidate-roots").withColumnRenamed("u", "print")
    grouped = staged(apart.join(roots, "print", "left").select("node", "own", F.coalesce("root", "print").alias("group")), "candidate-groups")
    # Written, so that the join deals both its sides out anew and Spark can split a large group's rows.
    several = staged(grouped.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group"), "groups-of-several")
    wanted = staged(grouped.join(several, "group").select("group", "node", F.col("own.id").alias("own_id"), F.col("own.text_hash").alias("own_hash")), "candidate-texts")
    own = F.xxhash64("id", "text_hash")
    maybe = flagged(rows, wanted, own, F.xxhash64("own_id", "own_hash"), "maybe").where("maybe")  # no other text is shuffled
    texts = maybe.join(wanted, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash")))
    sets = staged(texts.select("group", "node", "text").mapInArrow(cut, "group long, node long, shingles binary").dropDuplicates(["group", "node"]), "candidate-sets")
    roots = _verified(sets, similarity)
    return marked.join(roots, "node", "left").select(F.col("id").alias(id_col), "text_hash", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, *, words: int = WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all their columns, one row of each group: the row that ``simhash.keep_one`` keeps."""
    groups = near_groups(docs, words=words, similarity=similarity, id_col=id_col, text_col=text_col)
    return keep_first(docs, groups, id_col=id_col, text_col=text_col)
