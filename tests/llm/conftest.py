from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, content string, group string"


def _texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = prose(120)
    passage = prose(14)
    long = prose(6_000)
    near = base.split(" ")
    near[60] = "changed"
    return {
        "plain": base, "copy": base, "near": " ".join(near), "empty": "", "blank": " \n\t ", "null": None, "one": "word", "two": "two words",
        "long": long, "repeat": "a b c d e f a b c d e g h i j", "spam": "buy now " * 40, "lines": "same line\nsame line\n\nother\nsame line",
        "hit": prose(20) + " " + passage.upper() + ", " + prose(20), "passage": passage, "accents": "Été naïve — 漢字 emoji 😀 ß İstanbul x",
        "mail": "write to bob.x+1@mail.example.com or 10.0.0.256 and 10.1.2.3, card 4111 1111 1111 1111, call +1 (017) 555-7713.", "symbols": "a# b$ c| d<e> 100% *** &&",
    }


TEXTS = _texts()
PASSAGE = TEXTS["passage"]


@pytest.fixture(scope="session")
def texts():
    return TEXTS


@pytest.fixture(scope="session")
def documents(spark):
    """Every odd text once, one row repeated, a null id, a null source; columns with clashing names."""
    rows = [(i, t, ("en", "de", None)[i % 3], f"src{i % 3}" if i != 5 else None, None if t is None else len(t), 0.5, "x", "y") for i, t in enumerate(TEXTS.values())]
    rows += [rows[0], (None, "a row without an id but with a text of more than ten words in it", "en", "src0", 1, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
