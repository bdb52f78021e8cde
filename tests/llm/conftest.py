import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, key string, print string, word string, `a.b` int, TOKENS int"
WORDS = ["the", "and", "Thing", "ereth", "on", "of", "inor", "was", "thsh", "ning", "bleed", "ouan,", "la", "éaux", "que", "est"]


def row(k, text, lang="en", source="a"):
    return (k, text, lang, source, len(text or ""), 1, "k", "p", "w", 2, 3)


@pytest.fixture(scope="session")
def rows():
    """Ordinary texts, and nulls, empty and very long texts, ties, repeated rows and copies."""
    rng = random.Random(3)
    out = [row(k, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 120))), rng.choice(["en", "fr"]), rng.choice("abc")) for k in range(60)]
    long_text = " ".join(rng.choice(WORDS) for _ in range(30_000))
    out += [row(100, None), row(101, ""), row(102, " \n\t "), row(103, "123 4.5 -"), row(104, long_text), row(105, long_text + " end"), row(106, "x" * 9000)]
    out += [row(107, out[5][1]), row(107, out[5][1]), row(107, out[6][1]), row(None, out[7][1]), row(None, None), row(108, out[5][1], None, None)]
    out += [row(109, "a  b \n c <|endoftext|> d\u00a0e ▁ ﬁ \U0001f600 é"), row(110, "Don't  stop\n\nnow 12ab's", "en", None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
