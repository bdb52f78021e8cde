"""SimHash near-dedup with Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of 23, 23 and 18 bits. The perfect binary Golay code (23, 12) decodes a
segment to the index of the only codeword within three bits; a *fuzzy* segment is the set of indices that it and its
neighbours at one bit decode to, one or six of them. So if two segments differ in one bit at most, the index of one is
in the fuzzy set of the other. Three wrong bits over three segments are, in some order, (3,0,0), (2,1,0) or (1,1,1),
so a pair at distance three or less agrees in one of these keys, exact (E) or fuzzy (F) a segment:

    F F F | E E . | F E . | E F . | F . E | E . F | E . E | . F E | . E F | . E E

where (E E), (E . E) and (. E E) are contained in the fuzzy forms beside them. Each fingerprint is filed under the
indices of its segments and looked up under its fuzzy sets; what meets is verified by its differing bits. Equal
fingerprints are one from the start, and a bucket passes on a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import FILED, LOOKS, links
from .common import flagged, partitions, pieces, staged, table
from .components import components

MAX_BITS = 3
SEED = 42
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the code.
GENERATOR = 0b101011100011
#: Segments: first bit and number of bits.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Fingerprints whose keys are made at once.
SPREAD_ROWS = 2048


@cache
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """The remainder of each value of the 12 upper bits, and the error pattern of each remainder."""

    def remainder(value: int) -> int:
        for bit in range(22, 10, -1):
            if value >> bit & 1:
                value ^= GENERATOR << (bit - 11)
        return value

    upper = np.array([remainder(k << 11) for k in range(4096)], np.int64)
    errors = np.full(2048, -1, np.int64)
    bits = [1 << k for k in range(23)]
    patterns = [0, *bits, *(a | b for i, a in enumerate(bits) for b in bits[:i]), *(a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j])]
    for pattern in patterns:
        errors[upper[pattern >> 11] ^ (pattern & 2047)] = pattern
    return upper, errors


def golay_index(values: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword within three bits of each 23-bit value."""
    upper, errors = _golay()
    return (values ^ errors[upper[values >> 11] ^ (values & 2047)]) >> 11


def _fuzzy(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, bits + 1) indices of each value and its neighbours, and which of them are the first of their kind."""
    around = values[:, None] ^ np.array([0, *(1 << k for k in range(bits))], np.int64)
    found = np.sort(golay_index(around), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    return found, new


def _ragged(found: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of the marked entries."""
    return np.nonzero(new)[0], found[new]


def _cross(rows: np.ndarray, keys: np.ndarray, more_rows: np.ndarray, more: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """All combinations of the keys of a row; ``more_rows`` is in order and has every row."""
    sizes = np.bincount(more_rows)
    first = np.cumsum(sizes) - sizes
    times = sizes[rows]
    total = int(times.sum())
    at = np.repeat(first[rows] - (np.cumsum(times) - times), times) + np.arange(total)
    return np.repeat(rows, times), np.repeat(keys, times) << shift | more[at]


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of fingerprints (uint64): the row of each key, the key, and whether the row is filed or looks up."""
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    index = [golay_index(x) for x in parts]
    sets = [_ragged(*_fuzzy(x, bits)) for x, (_, bits) in zip(parts, SEGMENTS, strict=True)]
    rows = np.arange(len(prints))
    filed = [index[0] << 24 | index[1] << 12 | index[2]]
    looked = [_cross(*_cross(*sets[0], *sets[1], 12), *sets[2], 12)]
    for a, b in ((0, 1), (0, 2), (1, 2)):
        for exact, loose in ((a, b), (b, a)):
            filed.append(parts[exact] << 12 | index[loose])
            looked.append((sets[loose][0], parts[exact][sets[loose][0]] << 12 | sets[loose][1]))
    of, keys, roles = [], [], []
    for kind, (mine, (row, key)) in enumerate(zip(filed, looked, strict=True)):
        of += (rows, row)
        keys += (mine | kind << 40, key | kind << 40)
        roles += (np.full(len(rows), FILED, np.int8), np.full(len(row), LOOKS, np.int8))
    return np.concatenate(of), np.concatenate(keys), np.concatenate(roles)


def shingle_hashes(raw: bytes | None, words: int) -> list[int]:
    """The XXH64 of all shingles, repeats included; none for no words."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    tokens = (raw or b"").lower().split()  # bytes: A to Z alone, the space and 0x09 to 0x0D alone
    if len(tokens) <= words:
        return [digest(b" ".join(tokens), SEED)] if tokens else []
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1).tolist()
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=False)]


def fingerprint(raw: bytes | None, words: int) -> int:
    """Majority over the XXH64 of all shingles, repeats included; zero for no words."""
    hashes = shingle_hashes(raw, words)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0]) if hashes else 0


def fingerprints(docs: DataFrame, *, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, print): a hash of each whole text, and its fingerprint as a signed long."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = np.array([fingerprint(x, words) for x in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "text_hash", "print"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, text_hash long, print long")


def print_links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (u, v) between different fingerprints of ``prints`` that differ in ``max_bits`` (three at most) or less;
    a spanning forest of each bucket's."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the code finds at most {MAX_BITS} differing bits")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, SPREAD_ROWS):
            part = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            rows, keys, roles = fuzzy_keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(roles), pa.array(part[rows])], ["key", "role", "w0"])

    # A print has 188 keys, so tasks are dealt by prints and not by the few bytes of their file.
    dealt = prints.select("print").repartition(partitions(prints.sparkSession), "print")
    found = links(dealt.mapInArrow(spread, "key long, role byte, w0 long"), 1, max_bits)
    return found.select(F.col("u0").alias("u"), F.col("v0").alias("v"))


def near_groups(docs: DataFrame, *, words: int = 5, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, text_hash, print (signed long) and component_id, the least id reachable over links.

    Documents link when their fingerprints differ in ``max_bits`` or less. Texts without words, null ones included,
    have fingerprint zero and link like any other. Repeated rows each keep their row; null ids are never the least
    unless a component has no other. An empty table gives an empty result.
    """
    marked = staged(fingerprints(docs, words=words, id_col=id_col, text_col=text_col), "prints")
    alike = staged(marked.groupBy("print").agg(F.min("doc_id").alias("least")), "prints-apart")
    roots = components(staged(print_links(alike, max_bits), "links"))
    joined = alike.join(roots, alike["print"] == roots["u"], "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    ids = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = staged(joined.join(ids, "root").select("print", "component_id", "root"), "print-groups")
    return marked.join(named, "print").select(F.col("doc_id").alias(id_col), "text_hash", "print", "component_id", "root")


def keep_one(docs: DataFrame, *, words: int = 5, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all their columns, one row of each group: that of the least id, null ids last; of equal ids that of
    the least text hash, and of repeated rows one."""
    return keep_first(docs, near_groups(docs, words=words, max_bits=max_bits, id_col=id_col, text_col=text_col), id_col=id_col, text_col=text_col)


def keep_first(docs: DataFrame, groups: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that ``keep_one`` keeps of ``groups`` (id, text_hash, root). Rows travel as one struct, so
    their columns may have any names."""
    groups = staged(groups.select(F.col(id_col).alias("id"), "text_hash", "root"), "near-groups")
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")).alias("first"))
    kept = staged(first.select(F.col("first.id").alias("kept_id"), F.col("first.text_hash").alias("kept_hash")), "kept")
    own = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash"))
    # Most rows stay, and of those that may not, hashes are enough to tell: the others are neither shuffled nor joined.
    doubt = groups.groupBy("id", "text_hash").agg(F.count("*").alias("n")).join(kept, own, "left").where("kept_hash is null or n > 1")
    doubt = staged(doubt.select("id", "text_hash"), "not-kept")
    key = F.xxhash64("id", "text_hash")
    rows = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text_col}`").alias("text_hash"))
    rows = flagged(rows, doubt, key, key, "doubtful")
    found = rows.where("doubtful").join(kept, own, "left_semi").dropDuplicates(["id", "text_hash"])
    return rows.where("not doubtful").unionAll(found).select(*[F.col("row").getField(x).alias(x) for x in docs.columns])


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprint and component; texts without words, null ones too, have zero and link."""
    found = near_groups(table(spark, sf_dir, "documents"), words=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
