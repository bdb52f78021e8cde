"""Benchmark decontamination by the CGK random-walk embedding and bit sampling.

Texts and items are compared as UTF-8 with A to Z in lower case and white space as single spaces. An item leaks into
a text if some window of the text is within the item's edit limit, ``edit_rate`` of its bytes. An item of fewer than
``SHORT`` bytes leaks only by its exact words.

1. Windows. An item cut into pieces of eight bytes, or fewer where it is short, keeps at least ``pieces - limit`` of
   them unchanged, at places that shift by no more than the limit. Places of a text that show so many of an item's
   pieces, so aligned, open an item-sized window; no other window can be within the limit, so nothing is lost here.
2. Embedding. Window and item walk through the same random bits: at each step the current byte is written, and the
   step's bit for that byte says whether to go on. Edit distance so becomes Hamming distance.
3. Sampling. Each repetition compares a few sampled places of the embeddings; a window passes if one agrees in all.
   The number of repetitions is set, for the limit of each item, so that simulated edits reach the target recall; where
   ``MOST_ROUNDS`` of them don't, a repetition samples fewer places.
4. Verification. What passes is verified by exact edit distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, table

EDIT_RATE = 0.1
TARGET_RECALL = 0.995
PIECE = 8
#: Items of fewer bytes are too short to tell an edited one from chance.
SHORT = 16
SAMPLED = 5
WALKS = 3
MOST_ROUNDS = 200
#: Items go to the workers in blocks of so many bytes; a larger benchmark takes a pass over the texts for each block.
BLOCK_BYTES = 4 << 20
#: Text that is searched at once, and hits of pieces in it.
CHUNK_BYTES = 1 << 22
MOST_HITS = 1 << 21
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 20


def normal(raw: bytes | None) -> bytes:
    return b" ".join(raw.lower().split()) if raw else b""


def edit_limit(size: int, rate: float) -> int:
    """Edits allowed for an item of so many bytes."""
    return int(size * rate) if size >= SHORT else 0


def piece_size(size: int, limit: int) -> int:
    """Bytes of an item's pieces: of two more than its edits, two at least stay whole. A short item may be one piece."""
    return max(1, min(PIECE, size // (limit + 2) if size >= SHORT else size))


@lru_cache(4)
def _bits(walk: int, steps: int) -> np.ndarray:
    """Whether a walk goes on, by step and byte."""
    return np.random.default_rng([7, walk]).integers(0, 2, (steps, 256), np.int8).astype(bool)


def embed(rows: np.ndarray, sizes: np.ndarray, walk: int, steps: int) -> np.ndarray:
    """The embedding of each row (bytes, padded), one symbol a step; 256 once the row is at its end."""
    bits, at, every = _bits(walk, _round_up(steps)), np.zeros(len(rows), np.int64), np.arange(len(rows))
    out = np.full((len(rows), steps), 256, np.int16)
    last = rows.shape[1] - 1
    for step in range(steps):
        byte = rows[every, np.minimum(at, last)]
        on = at < sizes
        out[on, step] = byte[on]
        at += on & bits[step, byte]
    return out


def _round_up(steps: int) -> int:
    return 1 << max(10, (steps - 1).bit_length())


def edit_search(item: bytes, text: bytes, limit: int) -> tuple[int, int] | None:
    """Least edit distance of ``item`` to any part of ``text``, and that part's end; None beyond the limit.
    Bit-parallel, with one machine-independent integer for a whole column."""
    size = len(item)
    masks: dict[int, int] = {}
    for k, byte in enumerate(item):
        masks[byte] = masks.get(byte, 0) | 1 << k
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score = full, 0, size
    best, end = size, 0
    for k, byte in enumerate(text):
        match = masks.get(byte, 0)
        zero = (((match & up) + up) ^ up) | match | down
        right_up = down | (full & ~(zero | up))
        right_down = up & zero
        score += bool(right_up & top) - bool(right_down & top)
        right_up = (right_up << 1) & full  # a part may begin anywhere at no cost
        right_down = (right_down << 1) & full
        up = right_down | (full & ~(zero | right_up))
        down = right_up & zero
        if score < best:
            best, end = score, k + 1
    return (best, end) if best <= limit else None


@dataclass
class Items:
    """A block of items with all that the search needs."""

    ids: list
    texts: list[bytes]
    limits: np.ndarray
    need: np.ndarray
    #: Of each size of pieces: their values in order, the numbers of their items and places there.
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    places: list[np.ndarray]
    _known: dict[tuple[int, int], list[tuple[int, int]]] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list[tuple], rate: float = EDIT_RATE, recall: float = TARGET_RECALL) -> Items:
        rows = [(k, text) for k, text in ((k, normal(raw)) for k, raw in rows) if text]
        texts = [x for _, x in rows]
        limits = np.array([edit_limit(len(x), rate) for x in texts], np.int64)
        sizes = np.array([piece_size(len(x), n) for x, n in zip(texts, limits.tolist(), strict=True)], np.int64)
        seeds = {}
        for size in np.unique(sizes).tolist():
            own = [(int.from_bytes(texts[k][at : at + size], "little"), k, at) for k in np.flatnonzero(sizes == size).tolist() for at in range(0, len(texts[k]) - size + 1, size)]
            own.sort()
            seeds[size] = tuple(np.array([x[j] for x in own], np.uint64 if j == 0 else np.int64) for j in range(3))
        need = np.array([len(x) // n for x, n in zip(texts, sizes.tolist(), strict=True)], np.int64) - limits
        found = cls([k for k, _ in rows], texts, limits, need, seeds, [])
        found.places = [found._sampling(k, recall) for k in range(len(texts))]
        return found

    def _sampling(self, k: int, recall: float) -> np.ndarray:
        """(walk, repetition, place) samples for an item, as many repetitions as simulated edits need."""
        size, limit = len(self.texts[k]), int(self.limits[k])
        sampled, rounds = _rounds(self.texts[k], limit, recall, self._known.setdefault((size // 16, limit), [])) if limit else (SAMPLED, 1)
        return np.random.default_rng([11, size, limit]).integers(0, 2 * size, (WALKS, rounds, sampled))


def _rounds(text: bytes, limit: int, recall: float, known: list[tuple[int, int]]) -> tuple[int, int]:
    """Sampled places and repetitions for texts of this size and limit, from simulated edits of the first few such
    items."""
    if len(known) < 3:
        rng, same = np.random.default_rng([13, len(text), limit, len(known)]), []
        # As a window has them: of the item's size, with what stands behind it.
        behind = bytes(rng.permutation(np.frombuffer(text, np.uint8)))
        changed, steps = [(_edited(text, limit, rng) + behind)[: len(text)] for _ in range(64)], 2 * len(text)
        for walk in range(WALKS):
            same.append((embed(*_rows(changed), walk, steps) == embed(*_rows([text]), walk, steps)).mean(axis=1))
        for sampled in range(SAMPLED, 0, -1):
            # Walks fail apart: the chance that a repetition of any walk agrees, over the simulated texts.
            chance, rounds = (np.array(same) ** sampled).clip(1e-6, 1 - 1e-9), 1
            while rounds < MOST_ROUNDS and (1 - np.exp(np.log1p(-chance).sum(axis=0) * rounds)).mean() < recall:
                rounds += 1
            if rounds < MOST_ROUNDS:
                break
        known.append((sampled, rounds))
    least = min(x for x, _ in known)
    return least, max(n for x, n in known if x == least)


def _edited(text: bytes, edits: int, rng: np.random.Generator) -> bytes:
    out = bytearray(text)
    for _ in range(edits):
        at, kind, byte = int(rng.integers(0, len(out))), int(rng.integers(0, 3)), text[int(rng.integers(0, len(text)))]
        if kind == 0:
            out[at] = byte
        elif kind == 1:
            out.insert(at, byte)
        elif len(out) > 1:
            del out[at]
    return bytes(out)


def _rows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in texts], np.int64)
    rows = np.zeros((len(texts), max(1, int(sizes.max()))), np.uint8)
    for k, x in enumerate(texts):
        rows[k, : len(x)] = np.frombuffer(x, np.uint8)
    return rows, sizes


class Search:
    """Finds leaks of a block of items in batches of texts."""

    def __init__(self, items: Items) -> None:
        self.items = items
        self._own: dict[tuple[int, int], np.ndarray] = {}
        self._tables = {}
        for size, (values, _, _) in items.seeds.items():
            self._tables[size] = table = np.zeros(1 << _TABLE_BITS, bool)
            table[(values * _MIX) >> np.uint64(64 - _TABLE_BITS)] = True

    def _places(self, raw: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the text, in order, where a piece of this size may stand, and its values there."""
        words = np.ndarray(len(raw) - PIECE + 1, "<u8", raw, strides=(1,))
        mask, table = np.uint64((1 << 8 * size) - 1), self._tables[size]
        places, values = [], []
        for at in range(0, len(words), 1 << 18):
            part = words[at : at + (1 << 18)] & mask
            hit = np.flatnonzero(table[(part * _MIX) >> np.uint64(64 - _TABLE_BITS)])
            places.append(hit + at)
            values.append(part[hit])
        return np.concatenate(places), np.concatenate(values)

    def _hits(self, raw: bytes, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of the text, items and the pieces' places in them, in runs of about ``MOST_HITS``; the hits of a text
        and an item are never parted."""
        n = len(self.items.texts)
        for size, (seeds, item, at) in self.items.seeds.items():
            place, value = self._places(raw, size)
            low, high = np.searchsorted(seeds, value, "left"), np.searchsorted(seeds, value, "right")
            some = high > low
            place, low, high = place[some], low[some], high[some]
            doc, times = np.searchsorted(starts, place, "right"), np.cumsum(high - low)
            # Seeds of one value are in the order of their items, so that items can be taken range by range.
            ranked = np.cumsum(np.r_[False, seeds[1:] != seeds[:-1]]) * n + item
            begin = 0
            while begin < len(place):
                before = times[begin - 1] if begin else 0
                end = int(np.searchsorted(times, before + MOST_HITS, "right"))
                end = int(np.searchsorted(doc, doc[min(end, len(doc) - 1)], "left")) if end < len(doc) else end
                end = end if end > begin else int(np.searchsorted(doc, doc[begin], "right"))
                parts = -(-int(times[end - 1] - before) // MOST_HITS)
                for k in range(parts):
                    first, last = n * k // parts, n * (k + 1) // parts
                    base = ranked[low[begin:end]] - item[low[begin:end]]
                    a, b = np.searchsorted(ranked, base + first, "left"), np.searchsorted(ranked, base + last, "left")
                    each = b - a
                    which = np.repeat(a - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
                    yield np.repeat(place[begin:end], each), item[which], at[which]
                begin = end

    def find(self, texts: list[bytes]) -> list[list[tuple[int, int, int, int]]]:
        """For each normal text its leaks: item's number, distance, start and end, the closest of each item."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        if not self.items.seeds:
            return out
        # White space is a space here, so no piece of an item reaches over the line end between two texts.
        joined = b"\n".join(texts) + b"\n" * PIECE
        starts = np.cumsum([0, *(len(x) + 1 for x in texts)])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for hits in self._hits(joined, starts):
            windows = self._windows(len(joined), starts, *hits)
            for at in range(0, len(windows), 4096):
                self._check(windows[at : at + 4096], texts, best)
        for (d, k), (distance, start, end) in sorted(best.items()):
            out[d].append((k, distance, start, end))
        return out

    def _windows(self, size: int, starts: np.ndarray, place: np.ndarray, item: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int]]:
        """The windows (text, item, begin, run) that enough aligned hits open."""
        items = self.items
        doc, diagonal = np.searchsorted(starts, place, "right") - 1, place - at
        order = np.lexsort((diagonal, item, doc))
        doc, item, diagonal = doc[order], item[order], diagonal[order]
        # Hits from each place on that are within the limit's shift, of the same text and item.
        group = np.cumsum(np.r_[False, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])
        span = size + int(items.limits.max()) + 1
        line = group * (2 * span) + diagonal + span
        within = np.searchsorted(line, line + items.limits[item], "right") - np.arange(len(line))
        first = np.flatnonzero(within >= items.need[item])
        if not len(first):
            return []
        # Runs of such places are one alignment; every shift that it shows opens a window.
        open_ = np.zeros(len(line) + 1, np.int64)
        np.add.at(open_, first, 1)
        np.add.at(open_, first + within[first], -1)
        live = np.flatnonzero(np.cumsum(open_[:-1]) > 0)
        run = np.cumsum(np.r_[True, (np.diff(live) > 1) | (group[live[1:]] != group[live[:-1]])]) - 1
        fresh = np.r_[True, (run[1:] != run[:-1]) | (diagonal[live[1:]] != diagonal[live[:-1]])]
        live, run = live[fresh], run[fresh]
        begins = np.maximum(diagonal[live] - starts[doc[live]], 0)
        return list(zip(doc[live].tolist(), item[live].tolist(), begins.tolist(), run.tolist(), strict=True))

    def _check(self, windows: list[tuple[int, int, int, int]], texts: list[bytes], best: dict) -> None:
        """Embeds and samples windows (text, item, begin, run); a run of which one passes is verified, once."""
        items = self.items
        of = np.array([x[1] for x in windows])
        rows = _rows([texts[d][b : b + len(items.texts[k])] for d, k, b, _ in windows])
        passed = np.zeros(len(windows), bool)
        steps = 2 * max(len(items.texts[k]) for k in set(of.tolist()))
        for walk in range(WALKS):
            other = embed(*rows, walk, steps)
            for k in np.unique(of).tolist():
                mine = np.flatnonzero(of == k)
                if (k, walk) not in self._own:
                    self._own[k, walk] = embed(*_rows([items.texts[k]]), walk, 2 * len(items.texts[k]))[0]
                same = other[mine, : 2 * len(items.texts[k])] == self._own[k, walk]
                passed[mine] |= same[:, items.places[k][walk]].all(axis=2).any(axis=1)
        runs: dict[int, list[int]] = {}
        for j in np.flatnonzero(passed).tolist():
            runs.setdefault(windows[j][3], []).append(j)
        for own in runs.values():
            d, k = windows[own[0]][:2]
            limit, begins = int(items.limits[k]), [windows[j][2] for j in own]
            if len(items.texts[k]) < SHORT:
                begins = [b for b in begins if texts[d].startswith(items.texts[k], b) and texts[d][max(0, b - 1) : b] in (b"", b" ") and texts[d][b + len(items.texts[k]) :][:1] in (b"", b" ")]
                if begins:
                    best.setdefault((d, k), (0, min(begins), min(begins) + len(items.texts[k])))
                continue
            low = max(0, min(begins) - limit)
            found = edit_search(items.texts[k], texts[d][low : max(begins) + len(items.texts[k]) + limit], limit)
            known = best.get((d, k))
            if found and (known is None or found[0] < known[0]):
                best[d, k] = (found[0], max(0, low + found[1] - len(items.texts[k])), low + found[1])


def item_blocks(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The items in blocks of about ``block_bytes``, dealt out by a hash of the id."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = max(1, math.ceil(total / block_bytes))
    for k in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k)
        yield [(r.id, bytes(r.text) if r.text is not None else None) for r in part.toLocalIterator()]


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    first = size = 0
    for k, x in enumerate(texts):
        size += len(x)
        if size >= CHUNK_BYTES:
            yield first, texts[first : k + 1]
            first, size = k + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def find_leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", edit_rate: float = EDIT_RATE, recall: float = TARGET_RECALL) -> DataFrame:
    """One row for each document and item that leaks into it: id, item id, distance, start, end (bytes of the normal
    text, the closest place) and the item's edit limit.

    Null and empty texts have no leaks; null and empty items leak nowhere. Equal items are found alike; a document row that is repeated gives its rows again. Empty tables give an empty result. Only the named
    columns are used.
    """
    spark = docs.sparkSession
    id_type, item_type = docs.schema[id_col].dataType, items.schema[item_id].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    names = ["doc_id", "item_id", "distance", "start", "end", "edit_limit"]
    schema = T.StructType([T.StructField(x, t) for x, t in zip(names, [id_type, item_type, *[T.LongType()] * 4], strict=True)])
    found = None
    for block in item_blocks(items, id_col=item_id, text_col=item_text):
        held = spark.sparkContext.broadcast(Items.of(block, edit_rate, recall))  # bounded by BLOCK_BYTES

        def run(batches: Iterator[pa.RecordBatch], held: object = held) -> Iterator[pa.RecordBatch]:
            search = Search(held.value)
            for batch in pieces(batches, 1024):
                texts = [normal(x) for x in batch.column(1).to_pylist()]
                leaks = [(first + d, *leak) for first, part in _chunks(texts) for d, own in enumerate(search.find(part)) for leak in own]
                of = pa.array([x[0] for x in leaks], pa.int64())
                item = pa.array([search.items.ids[x[1]] for x in leaks])
                more = [pa.array([x[j] for x in leaks], pa.int64()) for j in (2, 3, 4)]
                limits = pa.array([int(search.items.limits[x[1]]) for x in leaks], pa.int64())
                if leaks:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(of), item, *more, limits], names)

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.unionAll(part)
    return found.withColumnsRenamed({"doc_id": id_col, "item_id": item_id})


def without_leaks(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", edit_rate: float = EDIT_RATE, recall: float = TARGET_RECALL) -> DataFrame:
    """The rows of ``docs`` into which no item leaks, with all their columns, whatever their names. Rows of null and empty
    texts stay, and of repeated rows all or none; an empty benchmark keeps all."""
    spark, kept = docs.sparkSession, docs
    for block in item_blocks(items, id_col=item_id, text_col=item_text):
        held = spark.sparkContext.broadcast(Items.of(block, edit_rate, recall))
        rows = kept.toDF(*[f"c{k}" for k in range(len(kept.columns))])  # names may hold dots or differ in case only
        place = kept.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch], held: object = held, place: int = place) -> Iterator[pa.RecordBatch]:
            search = Search(held.value)
            for batch in pieces(batches, 1024):
                raws = (x if isinstance(x, bytes) or x is None else x.encode() for x in batch.column(place).to_pylist())
                texts = [normal(x) for x in raws]
                yield batch.filter(pa.array([not own for _, part in _chunks(texts) for own in search.find(part)], pa.bool_()))

        kept = rows.mapInArrow(run, rows.schema).toDF(*kept.columns)
    return kept


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All leaks of ``benchmark`` into documents; null and empty texts have none, repeated rows each have theirs."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
