"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The network is trained here, in numpy, on windows with labelled spans: those that the patterns find in a bounded
sample of the documents, and spans written in many forms into slices of those documents. Every kind of span holds a
digit or an ``@``, so overlapping windows are laid around these alone. Each window is decoded by itself; spans that
touch an inner edge are left to the window beside it, and the others are reconciled over the whole text by weighted
interval scheduling. A span of the network must have its kind's form (a card its check digit) and overlap no span of
the patterns, which all stay.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

#: The sample is bounded by these: documents (in the mean, drawn by a hash of the id) and windows of each origin.
FIT_DOCS = 3000
FIT_WINDOWS = 600
WINDOW, STRIDE = 64, 32
HIDDEN = 24
EPOCHS = 14
_TAGS = 1 + 2 * len(KINDS)

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: From the first digit of a run alone: what fails there fails from its other digits too, and a long run is read once.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANCHOR = re.compile("[0-9@]")
_DIGIT = re.compile("[0-9]")


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def luhn(digits: str) -> bool:
    values = [int(x) for x in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * x, 10)) for x in values[1::2])) % 10 == 0


def _is_ip(text: str) -> bool:
    # More digits than three can still be small: zeros may stand before.
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in text.split("."))


def _is_card(text: str, check: bool = True) -> bool:
    digits = _digits(text)
    return 12 <= len(digits) <= 19 and (luhn(digits) or not check)


def _is_phone(text: str) -> bool:
    return 9 <= len(_digits(text)) <= 15


def _emails(text: str) -> Iterator[Span]:
    """What the pattern matches, found from each ``@`` to both sides, so that long runs of letters are read once."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end, "email"
        at = text.find("@", max(at + 1, end))


def base_spans(text: str, check: bool = True) -> list[Span]:
    """Spans of the patterns, leftmost and non-overlapping for each kind, by start, then kind. Without ``check`` a
    card needs no check digit."""
    found: list[Span] = []
    if "@" in text:
        found += _emails(text)
    if _DIGIT.search(text):
        found += [(*m.span(), "ip") for m in _IP.finditer(text) if _is_ip(m[0])]
        found += [(*m.span(), "card") for m in _CARD.finditer(text) if _is_card(m[0], check)]
        found += [(*m.span(), "phone") for m in _PHONE.finditer(text) if _is_phone(m[0])]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def _formed(text: str, kind: str) -> bool:
    """Whether a span of the network has its kind's form."""
    if kind == "email":
        return _EMAIL.fullmatch(text) is not None
    if kind == "ip":
        return _IP.fullmatch(text) is not None and _is_ip(text)
    if kind == "card":
        return re.fullmatch(r"[0-9](?:[  .-]?[0-9])+", text) is not None and _is_card(text)
    return re.fullmatch(r"\+?[0-9(][0-9 ().-]*[0-9]", text) is not None and _is_phone(text) and ("+" in text or "(" in text)


_CLASSES = "@.-+() \n_%:/\"',;#*$!?|="


def classes(text: str) -> np.ndarray:
    """The class of each character: digit, a to f, other small, capital, one of some marks, another letter, the rest."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _class_table()[np.minimum(codes, 0x300)]


N_CLASSES = 6 + len(_CLASSES) + 1  # the last one pads


def _class_table(known: list[np.ndarray] = []) -> np.ndarray:  # noqa: B006
    if not known:
        out = np.full(0x301, 5, np.int64)
        for k in range(0x301):
            c = chr(k)
            if c.isascii() and c.isdigit():
                out[k] = 0
            elif c in "abcdef":
                out[k] = 1
            elif "a" <= c <= "z":
                out[k] = 2
            elif "A" <= c <= "Z":
                out[k] = 3
            elif c in _CLASSES:
                out[k] = 6 + _CLASSES.index(c)
            elif c.isalpha() or k == 0x300:
                out[k] = 4
        known.append(out)
    return known[0]


PAD = N_CLASSES - 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Tagger:
    """The network. ``weights``: for each direction input, recurrent and bias; output and bias; CRF transitions."""

    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int) -> Tagger:
        rng = np.random.default_rng(seed)
        w: dict[str, np.ndarray] = {}
        for side in "fb":
            w[f"x{side}"] = rng.normal(0, 0.3, (N_CLASSES, 4 * HIDDEN))
            w[f"h{side}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
            w[f"b{side}"] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]
        w["out"] = rng.normal(0, 0.2, (2 * HIDDEN, _TAGS))
        w["bias"] = np.zeros(_TAGS)
        w["move"] = np.zeros((_TAGS, _TAGS))
        return cls(w)

    def _direction(self, x: np.ndarray, side: str) -> tuple[np.ndarray, list]:
        """Hidden states (windows, time, hidden) over ``x`` in that direction, and what going back needs."""
        w = self.weights
        n, size = x.shape
        h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        states, kept = np.zeros((n, size, HIDDEN)), []
        for t in range(size) if side == "f" else range(size - 1, -1, -1):
            z = w[f"x{side}"][x[:, t]] + h @ w[f"h{side}"] + w[f"b{side}"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            before = (h, c)
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            states[:, t] = h
            kept.append((t, i, f, o, g, tc, *before))
        return states, kept

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        forward, keep_f = self._direction(x, "f")
        backward, keep_b = self._direction(x, "b")
        both = np.concatenate([forward, backward], axis=2)
        return both @ self.weights["out"] + self.weights["bias"], both, (keep_f, keep_b)

    def _marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """CRF: log norm, tag marginals and expected transitions."""
        move = self.weights["move"]
        n, size, _ = e.shape
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, size):
            alpha[:, t] = e[:, t] + _log_sum(alpha[:, t - 1, :, None] + move, 1)
        for t in range(size - 2, -1, -1):
            beta[:, t] = _log_sum(move + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        norm = _log_sum(alpha[:, -1], 1)
        tags = np.exp(alpha + beta - norm[:, None, None])
        pairs = np.zeros_like(move)
        for t in range(size - 1):
            pairs += np.exp(alpha[:, t, :, None] + move + (e[:, t + 1] + beta[:, t + 1])[:, None, :] - norm[:, None, None]).sum(axis=0)
        return norm, tags, pairs

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean negative log likelihood of the tags ``y`` and its gradients."""
        w = self.weights
        n, size = x.shape
        e, both, kept = self.emissions(x)
        norm, tags, pairs = self._marginals(e)
        rows, times = np.arange(n)[:, None], np.arange(size)[None]
        loss = float((norm - e[rows, times, y].sum(axis=1) - w["move"][y[:, :-1], y[:, 1:]].sum(axis=1)).mean())
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        np.add.at(pairs, (y[:, :-1], y[:, 1:]), -1.0)
        grads["move"] = pairs / n
        de = tags
        de[rows, times, y] -= 1
        de /= n
        grads["out"] = np.einsum("nth,ntk->hk", both, de)
        grads["bias"] = de.sum(axis=(0, 1))
        dboth = de @ w["out"].T
        for side, keep, dh_all in (("f", kept[0], dboth[:, :, :HIDDEN]), ("b", kept[1], dboth[:, :, HIDDEN:])):
            dh, dc = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
            for t, i, f, o, g, tc, h0, c0 in reversed(keep):
                dh = dh + dh_all[:, t]
                dc = dc + dh * o * (1 - tc**2)
                dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)], axis=1)
                np.add.at(grads[f"x{side}"], x[:, t], dz)
                grads[f"h{side}"] += h0.T @ dz
                grads[f"b{side}"] += dz.sum(axis=0)
                dh, dc = dz @ w[f"h{side}"].T, dc * f
        return loss, grads

    def train(self, x: np.ndarray, y: np.ndarray, seed: int, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01) -> list[float]:
        """Adam over shuffled batches; the mean loss of each epoch."""
        rng, step, losses = np.random.default_rng(seed), 0, []
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for _ in range(epochs):
            order, total = rng.permutation(len(x)), 0.0
            for at in range(0, len(x), batch):
                part = order[at : at + batch]
                loss, grads = self.gradients(x[part], y[part])
                total += loss * len(part)
                step += 1
                size = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
                for k, g in grads.items():
                    g = g * min(1.0, 5.0 / (size + 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            losses.append(total / max(1, len(x)))
        return losses

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tag sequence of each window."""
        e, _, _ = self.emissions(x)
        move = self.weights["move"]
        n, size, _ = e.shape
        best, back = e[:, 0], np.zeros((n, size, _TAGS), np.int64)
        for t in range(1, size):
            through = best[:, :, None] + move
            back[:, t] = through.argmax(axis=1)
            best = e[:, t] + through.max(axis=1)
        tags = np.zeros((n, size), np.int64)
        tags[:, -1] = best.argmax(axis=1)
        for t in range(size - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(n), t, tags[:, t]]
        return tags


def tags_to_spans(tags: list[int]) -> list[Span]:
    spans, start, kind = [], -1, -1
    for k, tag in enumerate([*tags, 0]):
        if start >= 0 and (tag == 0 or tag % 2 == 1 or (tag - 1) // 2 != kind):
            spans.append((start, k, KINDS[kind]))
            start = -1
        if tag and start < 0:
            start, kind = k, (tag - 1) // 2
    return spans


def spans_to_tags(size: int, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(size, np.int64)
    for start, end, kind in spans:
        a, b, k = max(start, 0), min(end, size), KINDS.index(kind)
        if a < b:
            tags[a:b] = 2 * k + 2
            if a == start:
                tags[a] = 2 * k + 1
    return tags


def window_starts(text: str) -> list[int]:
    """Starts of the windows around all anchors of a text: each anchor is inside two at least, in the middle of one."""
    cells = sorted({m.start() // STRIDE for m in _ANCHOR.finditer(text)})
    return sorted({c * STRIDE - STRIDE // 2 + d for c in cells for d in (-STRIDE, 0, STRIDE) if c * STRIDE + d + WINDOW - STRIDE // 2 > 0 and c * STRIDE - STRIDE // 2 + d < len(text)})


def _window(codes: np.ndarray, start: int) -> np.ndarray:
    out = np.full(WINDOW, PAD, np.int64)
    a, b = max(start, 0), min(start + WINDOW, len(codes))
    if a < b:
        out[a - start : b - start] = codes[a:b]
    return out


def reconcile(votes: dict[Span, int]) -> list[Span]:
    """The spans of most weight (votes times length) that don't overlap, over the whole text."""
    spans = sorted(votes, key=lambda x: (x[1], x[0], KINDS.index(x[2])))
    ends = [x[1] for x in spans]
    best, take = [0] * (len(spans) + 1), [False] * len(spans)
    from bisect import bisect_right

    for k, (start, end, kind) in enumerate(spans):
        with_it = best[bisect_right(ends, start, 0, k)] + votes[start, end, kind] * (end - start)
        take[k] = with_it > best[k]
        best[k + 1] = max(best[k], with_it)
    out, k = [], len(spans)
    while k:
        if take[k - 1]:
            out.append(spans[k - 1])
            k = bisect_right(ends, spans[k - 1][0], 0, k - 1)
        else:
            k -= 1
    return out[::-1]


def joined_parts(parts: list[tuple[int, int, bool, bool]]) -> list[tuple[int, int]]:
    """Whole spans from the parts (start, end, begins, ends) that windows have of them: parts that overlap are one, from
    one that begins to one that ends. So a span may be longer than a window."""
    out, low, high, begun = [], 0, -1, False
    for start, end, begins, ends in sorted(parts):
        if start >= high:
            low, high, begun = start, end, begins
        high = max(high, end)
        if begun and ends and end == high:
            out.append((low, high))
    return out


def find_spans(texts: list[str], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """For each text the patterns' spans and the network's additional ones."""
    base = [base_spans(x) if _ANCHOR.search(x) else [] for x in texts]
    laid = [(k, start) for k, x in enumerate(texts) if _ANCHOR.search(x) for start in window_starts(x)]
    votes: dict[int, dict[Span, int]] = defaultdict(lambda: defaultdict(int))
    cut: dict[tuple[int, str], list[tuple[int, int, bool, bool]]] = defaultdict(list)

    def vote(k: int, low: int, high: int, kind: str) -> None:
        size = len(texts[k])
        apart = 0 <= low and high <= size and not (texts[k][low - 1 : low].isalnum() or texts[k][high : high + 1].isalnum())
        if apart and _formed(texts[k][low:high], kind):
            votes[k][low, high, kind] += 1

    for at in range(0, len(laid), 512):
        part = laid[at : at + 512]
        rows = np.stack([_window(classes(texts[k][max(0, start) : start + WINDOW]), min(0, start)) for k, start in part])
        for (k, start), tags in zip(part, tagger.decode(rows).tolist(), strict=True):
            if not any(tags):
                continue
            size = len(texts[k])
            for a, b, kind in tags_to_spans(tags):
                low, high = start + a, start + b
                begins, ends = a > 0 or low <= 0, b < WINDOW or high >= size
                if begins and ends:
                    vote(k, low, high, kind)
                else:
                    cut[k, kind].append((low, high, begins, ends))
    for (k, kind), parts in cut.items():
        for low, high in joined_parts(parts):
            vote(k, low, high, kind)
    out = []
    for k, own in enumerate(base):
        more = [x for x in reconcile(votes[k]) if not any(x[0] < b and a < x[1] for a, b, _ in own)] if k in votes else []
        out.append((own, more))
    return out


def _written(kind: str, rng: random.Random) -> str:
    """A span of that kind, in one of many forms."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8)))
    if kind == "email":
        return word() + rng.choice(["", ".", "_", "."]) + rng.choice(["", n(2), word()]) + "@" + word() + rng.choice(["", n(1)]) + rng.choice(["", ".example"]) + rng.choice([".com", ".org", ".net", ".de"])
    if kind == "ip":
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        form = rng.choice(["plain", "plain", " ", "-", "."])
        return n(rng.choice([12, 13, 15, 16, 16, 16, 19])) if form == "plain" else form.join(n(4) for _ in range(4))
    return rng.choice([f"+{n(1)} ({n(3)}) {n(3)}-{n(4)}", f"+{n(2)} {n(3)} {n(3)} {n(4)}", f"({n(3)}) {n(3)}-{n(4)}", f"+{n(2)}-{n(3)}-{n(7)}", f"+{n(11)}"])


def _no_span(rng: random.Random) -> str:
    """Something with digits that is none of the kinds."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    return rng.choice([f"{n(1)}.{n(1)}", f"{n(1)}.", n(4), n(2), f"{n(1)}.{n(1)}.{n(1)}", f"{n(3)},{n(3)}", f'"{"".join(rng.choice("0123456789abcdef") for _ in range(40))}"', n(rng.randint(22, 30)), f"{n(4)}-{n(2)}-{n(2)}", f"{n(2)}:{n(2)}"])


def labelled_windows(texts: list[str], seed: int = 0, most: int = FIT_WINDOWS) -> tuple[np.ndarray, np.ndarray]:
    """Training windows and tags: half from the patterns (cards by form), half written into slices of the texts."""
    rng = random.Random(seed)
    x, y = [], []
    real = [(text, start) for text in texts for start in (window_starts(text) if _ANCHOR.search(text) else [])]
    for text, start in rng.sample(real, min(most, len(real))):
        spans = [(a - start, b - start, k) for a, b, k in _apart(base_spans(text, check=False)) if b > start and a < start + WINDOW]
        x.append(_window(classes(text), start))
        y.append(spans_to_tags(WINDOW, spans))
    for _ in range(most):
        around = []
        for _ in range(2):
            text = rng.choice(texts) if texts else ""
            at = rng.randint(0, max(0, len(text) - 40))
            around.append(_DIGIT.sub("x", text[at : at + rng.randint(0, 40)]).replace("@", "x"))
        text, spans = around[0] + rng.choice([" ", " ", "\n", "(", ": "]), []
        for _ in range(rng.choice([1, 1, 1, 2])):
            if rng.random() < 0.3:
                text += _no_span(rng)
            else:
                kind = rng.choice(KINDS)
                span = _written(kind, rng)
                spans.append((len(text), len(text) + len(span), kind))
                text += span
            text += rng.choice([" ", " ", ", ", ". ", ""]) if not spans else rng.choice([" ", ", ", "; "])
        text += around[1]
        start = rng.randint(-8, max(0, len(around[0]) + 8))
        x.append(_window(classes(text), start))
        y.append(spans_to_tags(WINDOW, [(a - start, b - start, k) for a, b, k in spans]))
    return np.array(x), np.array(y)


def _apart(spans: list[Span]) -> list[Span]:
    """Longest first, those that don't overlap: a phone's digits can have the form of a card."""
    out: list[Span] = []
    for x in sorted(spans, key=lambda x: (x[0] - x[1], x[0])):
        if not any(x[0] < b and a < x[1] for a, b, _ in out):
            out.append(x)
    return out


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = FIT_DOCS, seed: int = 0) -> Tagger:
    """Trains on a sample of about ``fit_docs`` documents, drawn by a hash of the id; only what lies around anchors, or
    a slice without, is taken from each, so what comes to the driver is bounded."""
    rows = docs.select(F.xxhash64(F.lit("pii sample"), F.col(id_col)).alias("draw"), F.col(text_col).alias("text")).where(F.col(text_col).isNotNull())
    n = docs.count()
    drawn = rows.where(F.pmod("draw", F.lit(1 << 30)) < int(min(1.0, fit_docs / max(n, 1)) * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, draws = [], []
            for draw, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = _ANCHOR.search(text)
                at = max(0, found.start() - 100) if found else 0
                out.append(text[at : at + 300])
                draws.append(draw)
            yield pa.RecordBatch.from_arrays([pa.array(draws, pa.int64()), pa.array(out, pa.string())], ["draw", "text"])

    slices = drawn.mapInArrow(run, "draw long, text string").orderBy("draw", "text").limit(2 * fit_docs).collect()
    x, y = labelled_windows([r.text for r in slices], seed)
    tagger = Tagger.fresh(seed)
    tagger.train(x, y, seed)
    return tagger


def _line(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_personal_data(docs: DataFrame, tagger: Tagger, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, the number of the patterns' spans of each kind, base (their list), spans (theirs and
    the network's) as arrays of (start, end, kind, by) in code points, end exclusive, and both lists as lines.

    Null counts as empty. Repeated rows each keep their row; an empty table gives an empty result. Only the two named
    columns are used.
    """
    held = docs.sparkSession.sparkContext.broadcast(tagger)  # a few thousand numbers
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("by", T.StringType())])
    names = ["id", *(f"n_{k}" for k in KINDS), "base_line", "spans_line", "spans"]
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_line", T.StringType()), T.StructField("spans_line", T.StringType()), T.StructField("spans", T.ArrayType(span))])
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("by", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = find_spans([x or "" for x in part.column(1).to_pylist()], held.value)
                both = [sorted([*a, *b], key=lambda x: (x[0], KINDS.index(x[2]))) for a, b in found]
                columns = [part.column(0), *(pa.array([sum(x[2] == k for x in a) for a, _ in found], pa.int64()) for k in KINDS)]
                columns += [pa.array([_line(a) for a, _ in found]), pa.array([_line(x) for x in both])]
                marked = [[{"start": x[0], "end": x[1], "kind": x[2], "by": "model" if x in b else "pattern"} for x in all_] for (_, b), all_ in zip(found, both, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(marked, arrow)], names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents; null and empty texts have none, repeated rows each have their row."""
    docs = table(spark, sf_dir, "documents")
    found = find_personal_data(docs, fit(docs))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.col("base_line").cast("binary"), 256).alias("base_sha256"), F.col("spans_line").alias("spans"))
