import random

import pytest

WORDS = ["river", "stone", "Cloud", "amber", "quiet", "lantern", "forest", "signal", "copper", "meadow",
         "harbor", "velvet", "orchid", "thunder", "canvas", "pepper", "glacier", "saddle", "ribbon", "Éclair"]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every odd case: nulls, empty and long texts, repeated rows, clashing columns."""
    rows = [
        (1, prose(1, 80), "en", "a.example.org"), (2, None, "en", "b.example.org"), (3, "", None, None),
        (4, " \n\n ", "en", "b.example.org"), (5, prose(2, 30_000), "en", "c.example.com"),
        (6, prose(1, 80), "en", "d.example.com"), (1, prose(1, 80), "en", "a.example.org"),
        (None, prose(3, 120), "de", "a.example.org"), (None, None, None, None), (9, "x", "en", "b.example.org"),
        (10, "ab " * 4000, "en", "c.example.com"), (11, prose(3, 120) + " tail", "de", "a.example.org"),
        (12, "日本語のテキスト <|endoftext|> é́\t　z", "ja", "jp.example"),
    ]
    rows = [(*r, i, "k", f"t{i}", i) for i, r in enumerate(rows)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, id int, key string, _text string, _row int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
