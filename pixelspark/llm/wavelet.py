"""Token-id output as wavelet-matrix shards.

Each shard is one file, compressed to about the entropy of its ids: they get Huffman codes, the first bits of all codes
are the first bit plane, and each further plane has the next bits in the order that the planes above give, zeros
before ones. Codes are dealt out so that those that end at a plane are last in its order, and leave the planes below.
With the number of ones before each block of a plane, rank costs a pop count, and access, counting and occurrence
lookup touch one block a plane.

Layout (little-endian)::

    magic "WVMSHRD2" | u32 length of the header | header | sections | u32 crc32 of all before

The header is JSON: ``n`` ids, ``docs``, ``block`` (bits a block) and the place of each section. Sections:
``alphabet`` u32 ids in rising order, ``lengths`` u8 and ``counts`` u64 of each, ``doc_ids`` i64, ``doc_null`` u8,
``doc_starts`` u64 (docs + 1), and for each plane ``rank`` u64 (ones before each block) and ``bits``.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_kept, fresh_dir, kept, partitions, release_memory, staged, table

MAGIC = b"WVMSHRD2"
BLOCK_BITS = 1 << 12
SHARD_TOKENS = 1 << 20
#: Bytes of text that are encoded at once, and chunks whose ids a worker keeps. Both are memory against CPU time; the
#: ids are the same whatever they are.
ENCODE_BYTES = 1 << 22
KEPT_CHUNKS = 2_500_000


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman code lengths; small counts are raised until no code has more than 16 bits (24 for huge alphabets)."""
    if len(counts) < 2:
        return np.ones(len(counts), np.uint8)
    order, floor, most = np.argsort(counts, kind="stable"), 1, 16 if len(counts) <= 1 << 14 else 24
    while True:
        weights, n = np.maximum(counts[order], floor).tolist(), len(counts)
        parent, inner, leaf, node = [0] * (2 * n - 1), [], 0, 0
        for k in range(n - 1):
            total = 0
            for _ in range(2):  # the two lightest of leaves and inner nodes, which both are in order
                if leaf < n and (node >= len(inner) or weights[leaf] <= inner[node]):
                    total += weights[leaf]
                    parent[leaf] = n + k
                    leaf += 1
                else:
                    total += inner[node]
                    parent[n + node] = n + k
                    node += 1
            inner.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= most:
            out = np.zeros(n, np.uint8)
            out[order] = depth[:n]
            return out
        floor *= 2


def assign_codes(lengths: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The code of each symbol, and for each plane the symbols whose codes end there, in the order of that plane."""
    codes, ended, open_ = np.zeros(len(lengths), np.int64), [], np.zeros(1, np.int64)
    for size in range(1, int(lengths.max()) + 1 if len(lengths) else 1):
        open_ = np.concatenate([open_ << 1, open_ << 1 | 1])
        own = np.flatnonzero(lengths == size)
        codes[own] = open_[len(open_) - len(own) :]
        open_ = open_[: len(open_) - len(own)]
        ended.append(own)
    return codes, ended


def build_shard(ids: np.ndarray, doc_ids: list[int | None], doc_starts: np.ndarray, block_bits: int = BLOCK_BITS) -> bytes:
    """The file for ``ids``; ``doc_starts`` has one entry a document and the end."""
    ids = np.ascontiguousarray(ids)
    counts = np.bincount(ids)
    alphabet = np.flatnonzero(counts)
    counts = counts[alphabet]
    lengths = code_lengths(counts)
    codes, ended = assign_codes(lengths)
    top = 16 if len(ended) <= 16 else 32
    left = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 1, np.uint16 if top == 16 else np.uint32)
    left[alphabet] = codes << (top - lengths.astype(np.int64))
    sections: dict[str, bytes] = {
        "alphabet": alphabet.astype("<u4").tobytes(),
        "lengths": lengths.tobytes(),
        "counts": counts.astype("<u8").tobytes(),
        "doc_ids": np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
        "doc_null": np.array([x is None for x in doc_ids], "u1").tobytes(),
        "doc_starts": np.asarray(doc_starts, "<u8").tobytes(),
    }
    order = left[ids]
    for plane, own in enumerate(ended):
        one = (order & (1 << (top - 1 - plane))).astype(bool)
        packed = np.packbits(one, bitorder="little")
        ones = np.add.reduceat(np.bitwise_count(packed).astype(np.int64), np.arange(0, len(packed), block_bits // 8))
        sections[f"rank{plane}"] = np.r_[0, np.cumsum(ones)].astype("<u8").tobytes()
        sections[f"bits{plane}"] = packed.tobytes()
        stay = len(order) - int(counts[own].sum())
        order = order.take(np.concatenate([np.flatnonzero(~one), np.flatnonzero(one)])[:stay])  # no branch a bit, as a mask has
    places, place = {}, 0
    for name, part in sections.items():
        places[name] = [place, len(part)]
        place += len(part)
    header = json.dumps({"n": len(ids), "docs": len(doc_ids), "block": block_bits, "at": places}).encode()
    out = b"".join([MAGIC, struct.pack("<I", len(header)), header, *sections.values()])
    return out + struct.pack("<I", zlib.crc32(out))


class WaveletShard:
    """Reads one shard: ``access``, ``rank``, ``select``, ``count``, ``occurrences``, ``document`` and ``decode``."""

    def __init__(self, raw: bytes) -> None:
        if len(raw) < 16 or raw[:8] != MAGIC:
            raise ValueError("not a wavelet shard")
        if zlib.crc32(memoryview(raw)[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("the shard is damaged: its checksum differs")
        (size,) = struct.unpack("<I", raw[8:12])
        head = json.loads(raw[12 : 12 + size])
        self._raw, self._base, self._at = memoryview(raw), 12 + size, head["at"]
        self.n, self.block = head["n"], head["block"]
        self.alphabet, self._lengths, self._counts = self._part("alphabet", "<u4"), self._part("lengths", "u1"), self._part("counts", "<u8").astype(np.int64)
        self.doc_starts = self._part("doc_starts", "<u8").astype(np.int64)
        self.doc_ids = [None if gone else int(x) for x, gone in zip(self._part("doc_ids", "<i8"), self._part("doc_null", "u1"), strict=True)]
        self._codes, self._ended = assign_codes(self._lengths)
        self.planes = len(self._ended)
        #: Ids that reach each plane, and zeros there.
        self._sizes = [self.n]
        for own in self._ended:
            self._sizes.append(self._sizes[-1] - int(self._counts[own].sum()))
        self._ranks = [self._part(f"rank{k}", "<u8") for k in range(self.planes)]
        self._bits = [self._part(f"bits{k}", "u1") for k in range(self.planes)]
        self._zeros = [size - int(rank[-1]) for size, rank in zip(self._sizes, self._ranks, strict=False)]

    def _part(self, name: str, kind: str) -> np.ndarray:
        at, size = self._at[name]
        return np.frombuffer(self._raw[self._base + at : self._base + at + size], kind)

    def _bit(self, plane: int, i: int) -> int:
        return int(self._bits[plane][i >> 3]) >> (i & 7) & 1

    def _ones(self, plane: int, i: int) -> int:
        """Ones of a plane before place ``i``."""
        b = i // self.block
        first = b * self.block >> 3
        before = int(self._ranks[plane][b]) + int(np.bitwise_count(self._bits[plane][first : i >> 3]).sum(dtype=np.int64))
        return before + (int(self._bits[plane][i >> 3]) & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else before

    def _step(self, plane: int, bit: int, i: int) -> int:
        ones = self._ones(plane, i)
        return self._zeros[plane] + ones if bit else i - ones

    def _symbol(self, token: int) -> int | None:
        k = int(np.searchsorted(self.alphabet, token))
        return k if k < len(self.alphabet) and self.alphabet[k] == token else None

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        for plane in range(self.planes):
            i = self._step(plane, self._bit(plane, i), i)
            if i >= self._sizes[plane + 1]:
                own = self._ended[plane]
                k = int(np.searchsorted(np.cumsum(self._counts[own]), i - self._sizes[plane + 1], side="right"))
                return int(self.alphabet[own[k]])
        raise AssertionError("a code without an end")

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        k = self._symbol(token)
        if k is None:
            return 0, 0
        code, size = int(self._codes[k]), int(self._lengths[k])
        for plane in range(size):
            bit = code >> (size - 1 - plane) & 1
            lo, hi = self._step(plane, bit, lo), self._step(plane, bit, hi)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often ``token`` stands in places ``lo`` to ``hi`` (end exclusive)."""
        lo, hi = self._range(token, lo, self.n if hi is None else hi)
        return hi - lo

    def rank(self, token: int, i: int) -> int:
        """How often ``token`` stands before place ``i``."""
        return self.count(token, 0, i)

    def _select_bit(self, plane: int, bit: int, k: int) -> int:
        """The place of the ``k``-th (from 0) such bit of a plane."""
        size, ranks = self._sizes[plane], self._ranks[plane].astype(np.int64)
        if not bit:
            ranks = np.minimum(np.arange(len(ranks)) * self.block, size) - ranks
        b = int(np.searchsorted(ranks, k, side="right")) - 1
        first, last = b * self.block, min((b + 1) * self.block, size)
        flags = np.unpackbits(self._bits[plane][first >> 3 : (last + 7) >> 3], bitorder="little")[: last - first]
        return first + int(np.flatnonzero(flags == bit)[k - int(ranks[b])])

    def select(self, token: int, k: int) -> int:
        """The place of the ``k``-th (from 0) occurrence of ``token``."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        symbol, i = self._symbol(token), lo + k
        code, size = int(self._codes[symbol]), int(self._lengths[symbol])
        for plane in range(size - 1, -1, -1):
            bit = code >> (size - 1 - plane) & 1
            i = self._select_bit(plane, bit, i - self._zeros[plane] if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def document(self, d: int) -> np.ndarray:
        """The ids of the ``d``-th document of the shard."""
        return np.array([self.access(i) for i in range(int(self.doc_starts[d]), int(self.doc_starts[d + 1]))], np.uint32)

    def decode(self) -> np.ndarray:
        """All ids, from the bottom plane up."""
        kind = np.uint16 if not len(self.alphabet) or self.alphabet[-1] < 1 << 16 else np.uint32
        alphabet, below = self.alphabet.astype(kind), np.zeros(0, kind)
        for plane in range(self.planes - 1, -1, -1):
            own = self._ended[plane]
            below = np.concatenate([below, np.repeat(alphabet[own], self._counts[own])])
            one = np.unpackbits(self._bits[plane], count=self._sizes[plane], bitorder="little").view(bool)
            above, z = np.empty(self._sizes[plane], kind), self._zeros[plane]
            above[np.flatnonzero(~one)] = below[:z]
            above[np.flatnonzero(one)] = below[z:]
            below = above
        return below


#: A chunk that is empty or begins or ends with white space of any kind; of one that no space precedes the end counts.
_BLANK = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_ODD = f"^$|\\A{_BLANK}|{_BLANK}\\z"
_ODD_BARE = f"{_BLANK}\\z"
_WORD = "\\A[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+\\z"

#: ASCII letters; ASCII that is neither a letter nor the space; the leads of U+00C0 to U+017F, letters but for two.
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_OTHER = np.zeros(256, bool)
_OTHER[:128] = ~_LETTER[:128]
_OTHER[32] = False
_TIMES, _DIVISION = 0x97, 0xB7

#: Masks of the lowest bytes of a word.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class ChunkTable:
    """An open-addressing table in arrays, from chunks of up to 15 bytes to entry numbers.

    A key is the chunk's bytes themselves and its length, in two words, so two chunks are never taken for each other.
    The table grows with what is put into it, at 20 bytes a slot: five slots in eight are taken at most.
    """

    def __init__(self, bits: int = 12) -> None:
        self._n = 0
        self._clear(bits)

    def _clear(self, bits: int) -> None:
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys, self._entry = np.zeros((1 << bits, 2), np.uint64), np.full(1 << bits, -1, np.int32)

    @staticmethod
    def mixed(keys: np.ndarray) -> np.ndarray:
        mixed = (keys[:, 0] ^ (keys[:, 1] * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (self.mixed(keys) >> self._shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 where there is none."""
        slots, out, left = self._slots(keys), np.full(len(keys), -1, np.int32), np.arange(len(keys))
        while len(left):
            entries, held = self._entry.take(slots), self._keys.take(slots, axis=0)
            there = entries >= 0
            hit = (held[:, 0] == keys[:, 0]) & (held[:, 1] == keys[:, 1]) & there
            out[left] = np.where(hit, entries, -1)
            on = np.flatnonzero(there & ~hit)
            left, slots, keys = left[on], slots[on] + 1 & self._mask, keys[on]
        return out

    def put(self, keys: np.ndarray, entries: np.ndarray) -> None:
        """Different keys, none of them in the table."""
        self._n += len(keys)
        bits = (self._n * 8 // 5).bit_length()
        if 1 << bits > len(self._entry):
            taken = self._entry >= 0
            held = self._keys[taken], self._entry[taken]
            self._clear(bits)
            self._insert(*held)
        self._insert(keys, entries)

    def _insert(self, keys: np.ndarray, entries: np.ndarray) -> None:
        slots, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = self._entry[slots] < 0
            self._entry[slots[free]] = entries[left[free]]
            won = free & (self._entry[slots] == entries[left])
            self._keys[slots[won]] = keys[left[won]]
            left, slots = left[~won], slots[~won] + 1 & self._mask


class ChunkEncoder:
    """Encodes batches of texts with a byte-level BPE of the tokenizers library, each different chunk once.

    A chunk ends before a single space between two characters that aren't white space, and between a letter and other
    ASCII. The pre-tokenizer always starts a piece there: it joins such a space to what follows, none of its pieces
    goes on after a letter with what isn't one, and it doesn't look back. So the ids of a text are those of its chunks
    in turn. A text with other spaces, or with the string of an added token, is encoded as a whole, and so are all
    texts where the tokenizer isn't of that kind. Ids of chunks of up to 15 bytes are kept, ``most`` of them, and the
    ids of a batch are gathered from there in one step.
    """

    #: Chunks whose keys are looked up at once.
    BLOCK = 1 << 16
    #: The entry of odd chunks, whose texts are encoded as a whole.
    ODD = 0

    def __init__(self, path: str, most: int = KEPT_CHUNKS) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self.kind = np.dtype("<u2" if self._tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._special = tuple(str(x.content) for x in self._tokenizer.get_added_tokens_decoder().values())
        with open(path, encoding="utf-8") as file:
            kind = json.load(file)
        before = kind.get("pre_tokenizer") or {}
        self._parts = before.get("type") == "ByteLevel" and bool(before.get("use_regex", True)) and not before.get("add_prefix_space", True) and not kind.get("normalizer") and not any(" " in x for x in self._special)
        self._opens = np.zeros(max(self._tokenizer.get_vocab().values(), default=0) + 1, bool)
        for token, k in self._tokenizer.get_vocab().items():
            self._opens[k] = token.startswith("Ġ")  # byte-level BPE writes a space so
        # A space and letters are one piece, which needn't be looked for: the same model, parted at spaces alone.
        self._words = Tokenizer(self._tokenizer.model)
        self._words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "merged_with_next"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._most = most
        self._forget()

    def _forget(self) -> None:
        self._kept = ChunkTable()
        self._starts, self._sizes = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self._pool, self._entries, self._used = np.zeros(1 << 18, self.kind), 1, 0

    def _add(self, ids: list[list[int]]) -> int:
        """Puts ids into the pool, one entry each, and returns the first entry's number."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return self._put(np.fromiter(chain.from_iterable(ids), self.kind, int(sizes.sum())), sizes)

    def _put(self, flat: np.ndarray, sizes: np.ndarray) -> int:
        first, entries, used = self._entries, self._entries + len(sizes), self._used + len(flat)
        while entries > len(self._starts):
            self._starts, self._sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self._starts, self._sizes))
        while used > len(self._pool):
            self._pool = np.concatenate([self._pool, np.zeros_like(self._pool)])
        self._sizes[first:entries] = sizes
        self._starts[first:entries] = self._used + np.cumsum(sizes) - sizes
        self._pool[self._used : used] = flat
        self._entries, self._used = entries, used
        return first

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str], bare: np.ndarray) -> np.ndarray:
        """Encodes chunks, each after a space but for the bare ones, many in one call, and returns their entries. None
        has a space inside, so the ids that open with a space part them again."""
        named, entries = pa.array(chunks, pa.string()), np.full(len(chunks), self.ODD, np.int32)

        def like(pattern: str) -> np.ndarray:
            return pc.match_substring_regex(named, pattern).to_numpy(zero_copy_only=False)

        odd = np.where(bare, like(_ODD_BARE), like(_ODD))
        for special in self._special:
            odd |= pc.match_substring(named, special).to_numpy(zero_copy_only=False)
        words = like(_WORD) & ~bare
        for tokenizer, chosen in ((self._words, words & ~odd), (self._tokenizer, ~(words | bare | odd))):
            plain = np.flatnonzero(chosen)
            for at in range(0, len(plain), 1024):
                which = plain[at : at + 1024]
                part = [chunks[k] for k in which]
                ids = np.array(tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, self.kind)
                starts = np.flatnonzero(self._opens[ids])
                if len(starts) == len(part):
                    first = self._put(ids, np.diff(np.r_[starts, len(ids)]))
                else:
                    first = self._add(self._whole([" " + x for x in part]))
                entries[which] = np.arange(first, first + len(part))
        which = np.flatnonzero(bare & ~odd)
        first = self._add(self._whole([chunks[k] for k in which]))
        entries[which] = np.arange(first, first + len(which))
        return entries

    def _entries_of(self, raw: bytes, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bare: np.ndarray) -> np.ndarray:
        """The entries of chunks of ``raw``, of which ``words`` has the eight bytes from each place on."""
        entries = np.full(len(starts), -1, np.int32)
        for first in range(0, len(starts), self.BLOCK):
            part = slice(first, first + self.BLOCK)
            short = np.flatnonzero(sizes[part] < 16) + first
            entries[short] = self._entries_of_short(raw, words, starts[short], sizes[short], bare[short])
        long = np.flatnonzero(sizes >= 16)
        entries[long] = self._learn([raw[a : a + n].decode() for a, n in zip(starts[long].tolist(), sizes[long].tolist(), strict=True)], bare[long])
        return entries

    def _entries_of_short(self, raw: bytes, words: np.ndarray, at: np.ndarray, size: np.ndarray, bare: np.ndarray) -> np.ndarray:
        keys = np.empty((len(at), 2), np.uint64)
        keys[:, 0] = words[at] & _LOW[np.minimum(size, 8)]
        keys[:, 1] = words[at + 8] & _LOW[np.maximum(size - 8, 0)] | (size + 16 * bare).astype(np.uint64) << np.uint64(56)
        entries = self._kept.find(keys)
        new = np.flatnonzero(entries < 0)
        if len(new):
            order = new[np.argsort(ChunkTable.mixed(keys[new]))]  # equal ones together
            apart = np.r_[True, (keys[order[1:]] != keys[order[:-1]]).any(axis=1)]
            of = order[apart]
            learned = self._learn([raw[a : a + n].decode() for a, n in zip(at[of].tolist(), size[of].tolist(), strict=True)], bare[of])
            # Entries are numbers of their own but for the odd ones, which are put one after another for that.
            plain = learned != self.ODD
            self._kept.put(keys[of][plain], learned[plain])
            entries[order] = learned[np.cumsum(apart) - 1]
        return entries

    @staticmethod
    def _cuts(raw: np.ndarray) -> np.ndarray:
        """Where other ASCII follows a letter."""
        letter, lead = _LETTER[raw], raw[:-1]
        letter[1:] |= (lead >= 0xC3) & (lead <= 0xC5) & ((lead > 0xC3) | ((raw[1:] != _TIMES) & (raw[1:] != _DIVISION)))
        cuts = _OTHER[raw]
        cuts[1:] &= letter[:-1]
        cuts[:1] = False
        return cuts

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and how many each text has; no text is null."""
        if not len(texts):
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        if not self._parts:
            found = self._whole(texts.to_pylist())
            return np.fromiter(chain.from_iterable(found), self.kind), np.array([len(x) for x in found])
        if self._entries > self._most:
            self._forget()
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = b"" if texts.buffers()[2] is None else texts.buffers()[2][offsets[0] : offsets[-1]].to_pybytes()
        offsets = offsets - offsets[0]
        padded = np.frombuffer(raw + bytes(24), np.uint8)
        words = np.ndarray(len(raw) + 16, "<u8", padded, strides=(1,))
        marked = self._cuts(padded[: len(raw) + 1])
        marked[offsets[:-1]] = False
        marked[len(raw)] = False
        marked |= padded[: len(raw) + 1] == 32
        marks = np.flatnonzero(marked)
        cut = padded[marks] != 32
        counts = np.diff(np.searchsorted(marks, offsets)) + 1
        heads = np.cumsum(counts) - counts
        tails = np.ones(int(counts.sum()), bool)
        tails[heads] = False
        starts, ends = np.empty(len(tails), np.int64), np.empty(len(tails), np.int64)
        starts[heads], starts[tails] = offsets[:-1], marks + ~cut
        bare = np.zeros(len(tails), bool)
        bare[tails] = cut
        ends[heads + counts - 1] = offsets[1:]
        last = np.zeros(len(tails), bool)
        last[heads + counts - 1] = True
        ends[~last] = marks
        entries = self._entries_of(raw, words, starts, ends - starts, bare)
        odd = np.logical_or.reduceat(entries == self.ODD, heads)
        for special in self._special:  # which may be cut
            odd |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        # A text's first chunk has no space before it; of a text encoded as a whole it stands for all chunks.
        kept = self._entries, self._used
        stops = np.where(odd, offsets[1:], ends[heads])
        firsts = self._add(self._whole([raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), stops.tolist(), strict=True)]))
        entries[np.repeat(odd, counts)] = self.ODD
        entries[heads] = firsts + np.arange(len(texts))
        sizes = self._sizes[entries]
        before = np.cumsum(sizes, dtype=np.int32) - sizes
        at = np.repeat(self._starts[entries] - before, sizes)
        at += np.arange(len(at), dtype=np.int32)
        ids = self._pool.take(at)
        self._entries, self._used = kept  # what no other text asks for goes
        return ids, np.add.reduceat(sizes, heads)


def encoder_for(path: str, most: int = KEPT_CHUNKS) -> ChunkEncoder:
    """One encoder a worker process, with what it has kept, for all its tasks until those of another operator."""

    def make() -> ChunkEncoder:
        made = ChunkEncoder(path, most)
        release_memory()  # of the tokenizer's file
        return made

    return kept(("encoder", path, most), make)


def slices(batch: pa.RecordBatch, column: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about ``most_bytes`` together, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        done = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, done + most_bytes, side="right")))
        yield batch.slice(start, end - start)
        start = end


def with_token_counts(docs: DataFrame, tokenizer: str, *, text_col: str = "text", out: str, encode_bytes: int = ENCODE_BYTES, kept_chunks: int = KEPT_CHUNKS) -> DataFrame:
    """``docs`` with the number of each text's tokens as column ``out`` (long), without an end id; 0 for null and empty
    texts. Whatever names the other columns have, rows stay as they are; ``out`` replaces one of its name."""
    names = [x for x in docs.columns if x != out]
    rows = docs.select(*[F.col(f"`{x}`").alias(f"c{k}") for k, x in enumerate(names)], *[F.col(f"`{x}`").alias("t") for x in [text_col] if x not in names])
    # A text that stays among the columns goes to the workers once.
    place, others = names.index(text_col) if text_col in names else len(names), rows.columns[: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer, kept_chunks)
        for batch in batches:
            for piece in slices(batch, place, encode_bytes):
                counts = pa.array(encoder.encode(pc.fill_null(piece.column(place), ""))[1].astype(np.int64))
                yield pa.RecordBatch.from_arrays([*piece.columns[: len(names)], counts], [*others, "n"])
        release_memory()

    schema = rows.select(others).schema.add("n", "long")
    return rows.mapInArrow(run, schema).toDF(*names, out)


def _put(uri: str, raw: bytes, attempt: int) -> None:
    """Writes a whole file and moves it into place, so a retried task leaves the same file and no half of one."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(part := f"{path}.{attempt}.part") as out:
        out.write(raw)
    fs.move(part, path)


MANIFEST = "part int, seq int, name string, n_docs long, n_tokens long, n_bytes long"


def write_shards(docs: DataFrame, out: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, shard_tokens: int = SHARD_TOKENS, encode_bytes: int = ENCODE_BYTES, kept_chunks: int = KEPT_CHUNKS) -> DataFrame:
    """Encodes whole texts and writes them to ``out`` (a URI that all executors reach), one file a shard.

    Documents are in rising ``id_col`` order over all files in the order of their names; null ids come first, equal
    ids in the order of their texts. A null or empty text gives the end id alone. A shard ends with the document that
    fills it, so it holds ``shard_tokens`` ids or, at most, one document more. An empty table writes no file. Only the
    two named columns are used, whatever else the table has. Returns the manifest, one row a file.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, context = encoder_for(tokenizer, kept_chunks), TaskContext.get()
        part, attempt, seq = context.partitionId(), context.taskAttemptId(), 0
        held: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        starts = [0]

        def flush() -> pa.RecordBatch:
            nonlocal seq
            name = f"shard-{part:08d}-{seq:06d}.wvm"
            raw = build_shard(np.concatenate(held), doc_ids, np.array(starts))
            _put(f"{out}/{name}", raw, attempt)
            row = {"part": [part], "seq": [seq], "name": [name], "n_docs": [len(doc_ids)], "n_tokens": [starts[-1]], "n_bytes": [len(raw)]}
            seq += 1
            held.clear()
            doc_ids.clear()
            starts[:] = [0]
            return pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))

        for batch in batches:
            for piece in slices(batch, 1, encode_bytes):
                ids, counts = encoder.encode(piece.column(1))
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id)
                ends += np.arange(1, len(ends) + 1)
                begin = first = 0
                for row, (doc_id, end) in enumerate(zip(piece.column(0).to_pylist(), ends.tolist(), strict=True)):
                    doc_ids.append(doc_id)
                    starts.append(starts[-1] + end - begin)
                    begin = end
                    if starts[-1] >= shard_tokens or row + 1 == len(ends):
                        held.append(ids[first:end])
                        first = end
                    if starts[-1] >= shard_tokens:
                        yield flush()
        if doc_ids:
            yield flush()
        release_memory()

    # By way of a shuffle, so that a row or two of each task don't make a file each.
    return staged(rows.mapInArrow(run, MANIFEST).repartition("part"), "wavelet-manifest")


def read_shards(spark: SparkSession, out: str, manifest: DataFrame) -> DataFrame:
    """Every document of the shards below ``out``, from the files themselves: doc_id, start (ids of all documents
    before it), n_tokens and the crc32 of its ids as little-endian 32-bit integers, with its file and row there."""
    schema = "name string, row long, doc_id long, local_start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = WaveletShard(raw.as_py())
                ids, starts = memoryview(shard.decode().astype("<u4").tobytes()), shard.doc_starts
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path.rpartition("/")[2]] * len(shard.doc_ids), pa.string()),
                        pa.array(np.arange(len(shard.doc_ids))),
                        pa.array(shard.doc_ids, pa.int64()),
                        pa.array(starts[:-1]),
                        pa.array(np.diff(starts)),
                        pa.array([zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)], pa.int64()),
                    ],
                    ["name", "row", "doc_id", "local_start", "n_tokens", "ids_crc32"],
                )

    # Totals of partitions first, then of files within one: no window sees more rows than there are of either.
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    parts = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    offsets = manifest.withColumn("within", within).join(parts, "part").select("name", (F.col("before") + F.col("within")).alias("before"))
    if manifest.isEmpty():
        docs = spark.createDataFrame([], schema)
    else:
        docs = spark.read.format("binaryFile").option("pathGlobFilter", "*.wvm").load(out).select("path", "content").mapInArrow(run, schema)
    return docs.join(offsets, "name").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", F.col("name").alias("shard"), "row")


def token_output(docs: DataFrame, tokenizer: str, **options: object) -> DataFrame:
    """Writes the shards to a new folder of the shared directory and returns what reading them gives."""
    out = fresh_dir(docs.sparkSession, "wavelet")
    return read_shards(docs.sparkSession, out, write_shards(docs, out, tokenizer, **options))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as the shard files give them back: nulls and empty texts as the end id alone, repeated rows each."""
    return token_output(table(spark, sf_dir, "documents"), default_tokenizer())
