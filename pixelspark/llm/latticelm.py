"""Language-model scores of whole documents by a subword lattice.

The vocabulary is that of an existing subword model. Each piece has a unigram probability, learned from the words of
the training documents; a word's probability is the sum over all its segmentations into pieces, found by a forward
recursion in log space. Pieces never cross white space, so a text's probability is the product of its words' and of
the end's, and each different word of the corpus is run through its lattice once.

Frequent words, at most ``HOT_WORDS``, go to the workers as a dictionary; all others are joined by a shuffle on the
word. So counts and scores cover every word, and no frequent word makes a hot key.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, pieces, staged, table

#: The workers' dictionary has at most so many words.
HOT_WORDS = 250_000
#: Entries that a task tallies before it passes them on to the shuffle.
TALLY = 400_000
SMOOTH = 0.1
MARK = "▁"


def words_of(raw: bytes | None) -> list[bytes]:
    """Words of the UTF-8 text with A to Z in lower case; none for null. bytes.lower() changes A to Z alone, and
    bytes.split() parts at the space and 0x09 to 0x0D alone."""
    return raw.lower().split() if raw else []


@dataclass
class Lattice:
    """Log10 probabilities of pieces, of bytes for characters that are no piece, and of the end."""

    pieces: dict[str, float]
    bytes_: list[float]
    end: float
    _singles: dict[str, float] = field(default_factory=dict)

    @classmethod
    def from_counts(cls, vocabulary: list[str], counts: dict[str, int], ends: int) -> Lattice:
        """Every piece of ``vocabulary`` with its relative frequency, ``SMOOTH`` added; bytes are named ``<0xNN>``."""
        total = sum(counts.values()) + ends + SMOOTH * (len(vocabulary) + 1)
        scores = {x: math.log10((counts.get(x, 0) + SMOOTH) / total) for x in vocabulary}
        bytes_ = [scores.pop(f"<0x{k:02X}>", math.log10(SMOOTH / total)) for k in range(256)]
        return cls(scores, bytes_, math.log10((ends + SMOOTH) / total))

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)

    @cached_property
    def _opening(self) -> dict[str, int]:
        """For each first character, the length of the longest piece that begins with it."""
        found: dict[str, int] = {}
        for x in self.pieces:
            found[x[0]] = max(found.get(x[0], 1), len(x))
        return found

    def _by_bytes(self, char: str) -> float:
        found = self._singles.get(char)
        if found is None:
            found = sum(self.bytes_[x] for x in char.encode("utf-8", "surrogatepass"))
            if len(self._singles) < 10_000:
                self._singles[char] = found
        return found

    def word(self, word: str) -> float:
        """Log10 probability of the word over all segmentations: the forward recursion.

        A character that is no piece of its own can also be spelled in bytes. The mark of the vocabulary for a space
        stands before the word; that character inside a word is spelled in bytes.
        """
        pieces, opening = self.pieces, self._opening
        text = MARK + word
        n = len(text)
        ahead: list[float] = [0.0] + [-math.inf] * n
        for at in range(n):
            here = ahead[at]
            if here == -math.inf:
                continue
            first = text[at]
            if at and first == MARK:
                most = 0
            else:
                most = min(opening.get(first, 0), n - at)
            for size in range(1, most + 1):
                score = pieces.get(text[at : at + size])
                if score is not None and not (size > 1 and MARK in text[at + 1 : at + size]):
                    ahead[at + size] = _plus(ahead[at + size], here + score)
            if at and first == MARK or first not in pieces:
                ahead[at + 1] = _plus(ahead[at + 1], here + self._by_bytes(first))
        return ahead[n]


def _plus(a: float, b: float) -> float:
    """log10(10^a + 10^b)."""
    if a < b:
        a, b = b, a
    return a if b == -math.inf or a - b > 17 else a + math.log10(1 + 10 ** (b - a))


def vocabulary_of(path: str) -> list[str]:
    """Pieces that can stand in a word, and the byte pieces, of a sentencepiece model; controls are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = []
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        if model.is_byte(k) or not (model.is_control(k) or model.is_unknown(k) or MARK in piece[1:]):
            found.append(piece)
    return found


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n_train, n_all) over all ``rows`` (train boolean, text in bytes). Tasks tally before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: tuple[Counter[bytes], Counter[bytes]] = (Counter(), Counter())

        def flush() -> Iterator[pa.RecordBatch]:
            for train, tally in enumerate(tallies):
                words, counts = list(tally), list(tally.values())
                tally.clear()
                for at in range(0, len(words), 50_000):
                    n = pa.array(counts[at : at + 50_000], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 50_000], pa.binary()), n if train else pa.array([0] * len(n), pa.int64()), n], ["word", "n_train", "n_all"])

        for batch in pieces(batches):
            for train, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tallies[bool(train)].update(words_of(text))
                if len(tallies[0]) + len(tallies[1]) > TALLY:
                    yield from flush()
        yield from flush()

    tallied = rows.select("train", "text").mapInArrow(run, "word binary, n_train long, n_all long")
    return tallied.groupBy("word").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all"))


def piece_counts(counts: DataFrame, path: str) -> dict[str, int]:
    """How often each piece stands in the training words as the subword model cuts them; bounded by its vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        tally: Counter[int] = Counter()
        for batch in batches:
            words, sizes = [x.decode() for x in batch.column(0).to_pylist()], batch.column(1).to_pylist()
            for at in range(0, len(words), 4096):
                for ids, n in zip(model.encode(words[at : at + 4096], num_threads=1), sizes[at : at + 4096], strict=True):
                    for k in ids:
                        tally[k] += n
        yield pa.RecordBatch.from_pydict({"piece": [model.id_to_piece(k) for k in tally], "n": list(tally.values())}, pa.schema([("piece", pa.string()), ("n", pa.int64())]))

    tallied = counts.where("n_train > 0").select("word", "n_train").mapInArrow(run, "piece string, n long")
    return {r.piece: r.n for r in tallied.groupBy("piece").agg(F.sum("n").alias("n")).collect()}


def score_documents(docs: DataFrame, vocabulary: str, *, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", hot_words: int = HOT_WORDS) -> DataFrame:
    """One row a document: id, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities).

    Tokens are the words and one end. ``train`` is a boolean Column over ``docs`` (null: no); without it all rows
    train. base_score is the word unigram with 0.1 added, score the subword lattice. A null or empty text has the end
    alone. Repeated rows and null or equal ids each keep their row; with no training row all counts are zero and base
    scores are those of an empty model. Only the named columns are used.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.lit(True) if train is None else F.coalesce(train, F.lit(False))).alias("train"), F.col(text_col).cast("binary").alias("text"))
    counts = staged(word_counts(rows), "lm-counts")
    sums = counts.agg(F.sum("n_train").alias("n"), F.count(F.when(F.col("n_train") > 0, 1)).alias("v")).first()
    ends = rows.where("train").count()
    tokens, different = (sums.n or 0) + ends, sums.v + (ends > 0)
    lattice = Lattice.from_counts(vocabulary_of(vocabulary), piece_counts(counts, vocabulary), ends)
    model = spark.sparkContext.broadcast(lattice)  # bounded by the vocabulary
    log_all = math.log10(tokens + SMOOTH * (different + 1))

    def lattice_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.value.word
        for batch in batches:
            found = pa.array([score(x.decode()) for x in batch.column(0).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], ["word", "n_train", "n_all", "score"])

    scored = counts.mapInArrow(lattice_scores, "word binary, n_train long, n_all long, score double")
    scored = staged(scored.withColumn("base", F.log10(F.col("n_train") + SMOOTH) - log_all), "lm-words")
    # The least frequency whose words fit the dictionary, from a histogram over frequencies in steps of 2 %.
    step = F.floor(F.log("n_all") / math.log(1.02)).cast("int")
    steps = sorted(((r.step, r.n) for r in scored.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    held, least = 0, None
    for place, n in steps:
        if (held := held + n) > hot_words:
            break
        least = place
    hot_rows = scored.where(step >= least).select("word", (F.col("n_train") > 0).alias("known"), "base", "score").toArrow().to_pydict() if least is not None else {"word": []}
    hot = spark.sparkContext.broadcast({w: (int(k), b, s) for w, k, b, s in zip(hot_rows["word"], hot_rows["known"], hot_rows["base"], hot_rows["score"], strict=True)} if hot_rows["word"] else {})
    end_base, end_known = math.log10(ends + SMOOTH) - log_all, int(ends > 0)
    end_score = lattice.end

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"row long, doc_id {id_type}, train boolean, word binary, n long, n_tokens long, n_known long, base double, score double"

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document with what the dictionary gives, and one for each of its other words."""
        known = hot.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                of, rare, times = [], [], []  # of other words: the document's place, the word, how often
                totals: list[tuple[int, int, float, float]] = []
                for k, text in enumerate(part.column(3).to_pylist()):
                    words = words_of(text)
                    n_known, base, score = end_known, end_base, end_score
                    for word, n in Counter(words).items():
                        found = known.get(word)
                        if found is None:
                            of.append(k)
                            rare.append(word)
                            times.append(n)
                        else:
                            n_known += n * found[0]
                            base += n * found[1]
                            score += n * found[2]
                    totals.append((len(words) + 1, n_known, base, score))
                rows_, size, others = part.column(0), part.num_rows, len(rare)
                # No word has a space inside, so these keys join nothing and are dealt out evenly.
                keys = pa.array([b" %d" % x for x in rows_.to_pylist()] + rare, pa.binary())
                zeros = [0] * others
                yield pa.RecordBatch.from_arrays(
                    [
                        rows_.take(pa.array([*range(size), *of], pa.int64())),
                        pa.concat_arrays([part.column(1), pa.nulls(others, part.column(1).type)]),
                        pa.concat_arrays([part.column(2), pa.nulls(others, pa.bool_())]),
                        keys,
                        pa.array([0] * size + times, pa.int64()),
                        pa.array([x[0] for x in totals] + zeros, pa.int64()),
                        pa.array([x[1] for x in totals] + zeros, pa.int64()),
                        pa.array([x[2] for x in totals] + zeros, pa.float64()),
                        pa.array([x[3] for x in totals] + zeros, pa.float64()),
                    ],
                    ["row", "doc_id", "train", "word", "n", "n_tokens", "n_known", "base", "score"],
                )

    spread_rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "train", "text").mapInArrow(spread, schema)
    others = (scored if least is None else scored.where(step < least)).select("word", (F.col("n_train") > 0).cast("long").alias("w_known"), F.col("base").alias("w_base"), F.col("score").alias("w_score"))
    joined = spread_rows.join(others, "word", "left")
    with_word = lambda total, a_word: F.sum(F.col(total) + F.col("n") * F.coalesce(a_word, F.lit(0)))
    found = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("train").alias("train"),
        F.sum("n_tokens").alias("n_tokens"),
        with_word("n_known", "w_known").alias("n_known"),
        with_word("base", "w_base").alias("base_score"),
        with_word("score", "w_score").alias("score"),
    )
    return found.select(F.col("doc_id").alias(id_col), "train", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents; null and empty texts are their end alone, and repeated rows each count and have a row."""
    docs = table(spark, sf_dir, "documents")
    scores = score_documents(docs, default_vocabulary(), train=crc_fold(F.col("doc_id"), 10) != 0)
    return scores.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
