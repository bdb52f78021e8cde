import random
import re
import time

import numpy as np
import pytest

from pixelspark.llm import pii


def brute(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for found in re.finditer(pattern, text):
            digits = [int(c) for c in found[0] if c in "0123456789"]
            doubled = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))]
            good = {"email": True, "ip": all(int(x) <= 255 for x in found[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((*found.span(), kind))
    return sorted(out, key=lambda x: (x[0], pii.KINDS.index(x[2])))


TEXTS = [
    "", "no data", "mail a.b+c@d-e.example.com, 1.2.3.4 and 256.1.1.1 or 0001.2.3.4.5", "4111 1111 1111 1111", "4111111111111111 5500005555555559",
    "+1 (614) 555-2942, +49 30 123456-78 +123", "é 4111-1111-1111-1112 4111-1111-1111-1111 ü", "@ 1@ a@b a@b.c.", "x" * 5000 + " 10.0.0.1 " + "y" * 5000,
]


def test_patterns():
    rng = random.Random(1)
    made = ["".join(rng.choice("ab1.2@@_%+- ()é") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    made += ["".join(rng.choice("0123.. -+()") for _ in range(rng.randint(10, 60))) for _ in range(3000)]
    for text in TEXTS + made + ["a@b.cd_x@e.fg", "a@b.cd@e.fg", "1.2.3.4.5.6.7.8", "4111111111111111" * 3]:
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_take_linear_time():
    began = time.perf_counter()
    assert len(pii.base_spans("x" * 300_000 + " a@b.c " + "1" * 300_000)) == 1
    assert time.perf_counter() - began < 5


def test_gradients_match_differences():
    x, y = pii.labelled_windows(TEXTS[:4], seed=2, most=4)
    tagger = pii.Tagger.fresh(1)
    _, grads = tagger.gradients(x, y)
    rng = np.random.default_rng(0)
    for name, weight in tagger.weights.items():
        place = tuple(int(rng.integers(0, n)) for n in weight.shape)
        old = weight[place]
        weight[place] = old + 1e-5
        up, _ = tagger.gradients(x, y)
        weight[place] = old - 1e-5
        down, _ = tagger.gradients(x, y)
        weight[place] = old
        assert grads[name][place] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_decoding_is_the_best_sequence():
    tagger = pii.Tagger.fresh(3)
    tagger.weights["move"] = np.random.default_rng(0).normal(size=tagger.weights["move"].shape)
    x = np.array([[0, 1, 6, 2]])
    e = tagger.emissions(x)[0][0]
    move = tagger.weights["move"]
    import itertools

    best = max(itertools.product(range(9), repeat=4), key=lambda t: sum(e[k, a] for k, a in enumerate(t)) + sum(move[a, b] for a, b in zip(t, t[1:], strict=False)))
    assert tagger.decode(x)[0].tolist() == list(best)


def test_reconcile_takes_the_heaviest_set():
    assert pii.reconcile({(0, 5, "ip"): 1, (4, 8, "card"): 1, (5, 9, "card"): 1}) == [(0, 5, "ip"), (5, 9, "card")]
    assert pii.reconcile({(0, 5, "ip"): 1, (3, 9, "card"): 2}) == [(3, 9, "card")]


@pytest.fixture(scope="module")
def tagger(docs):
    return pii.fit(docs)


def test_network_adds_and_never_takes(spark, docs, rows, tagger):
    own = [(k, x, 1) for k, x in enumerate(TEXTS)] + [(50, "call (614) 555-2942 now", 1), (51, "4111.1111.1111.1111 ok", 1), (52, None, 1), (53, 'token = "5aad00685accefdd91653537b82ad0dab34e35e3" 9093441080585879', 1)]
    found = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(own, "doc_id long, text string, spans int"), tagger).collect()}
    for k, text, _ in own:
        spans = [(s.start, s.end, s.kind) for s in found[k].spans]
        base = brute(text or "")
        assert set(base) <= set(spans) and found[k].base_line == ",".join(f"{c}:{a}:{b}" for a, b, c in base)
        assert [found[k][f"n_{x}"] for x in pii.KINDS] == [sum(s[2] == x for s in base) for x in pii.KINDS]
    assert {s.kind for s in found[51].spans} <= {"card"} and not found[53].spans
    assert pii.find_personal_data(docs, tagger).count() == len(rows)


def test_held_out_spans_of_the_network(tagger):
    x, y = pii.labelled_windows(["some words that stand around", "more of them, and others"] * 5, seed=99, most=300)
    same = (tagger.decode(x) == y)[y > 0].mean()
    assert same > 0.85


def test_empty(empty, tagger):
    assert pii.find_personal_data(empty, tagger).count() == 0
    assert pii.fit(empty).weights


def test_spans_cut_by_windows_are_whole_at_every_place():
    """A tagger that knows the span: windows cut it wherever it stands, and for spans longer than a window."""

    class Known:
        def __init__(self, spans):
            self.spans = spans

        def decode(self, rows):
            out = []
            for start in self.starts:
                own = [(max(0, a - start), min(pii.WINDOW, b - start), k) for a, b, k in self.spans if a < start + pii.WINDOW and b > start]
                out.append(pii.spans_to_tags(pii.WINDOW, own))
            return np.array(out)

    for size in (18, 33, 50, 64, 90):
        form = "+49 " + "3" * 9 + "(" * (size - 13 - 1) + "1"
        assert len(form) == size
        for place in range(64):
            text = "x" * place + " " + form + " " + "y" * 50
            tagger = Known([(place + 1, place + 1 + size, "phone")])
            tagger.starts = pii.window_starts(text)
            with pytest.MonkeyPatch.context() as patch:
                patch.setattr(pii, "_formed", lambda text, kind: True)
                patch.setattr(pii, "base_spans", lambda text, check=True: [])
                assert pii.find_spans([text], tagger)[0][1] == [(place + 1, place + 1 + size, "phone")], (size, place)
