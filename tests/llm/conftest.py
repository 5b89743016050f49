import random

import pytest

SYLLABLES = "an en on re ti th er in ou st ed ha le ve ro mi ka lo su pe".split()


def make_words(seed: int, count: int) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choices(SYLLABLES, k=draw.randint(1, 3))) for _ in range(count)]


def make_text(seed: int, count: int = 120) -> str:
    draw = random.Random(seed)
    return "".join(
        w + ("\n" if draw.random() < 0.05 else " ") for w in make_words(seed, count)
    ).strip()


def edited(text: str, seed: int, changes: int) -> str:
    draw, own = random.Random(seed), text.split(" ")
    for _ in range(changes):
        own[draw.randrange(len(own))] = "zz" + str(draw.randrange(1000))
    return " ".join(own)


ODD_SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long,"
    " id string, node string, key string, digest string, ids string, score string, lines string,"
    " n_words string, state string, copies string, h1 string, row string, `a.b` string"
)


@pytest.fixture(scope="session")
def odd_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing column names."""
    clash = (True, 1, "i", "n", "k", "d", "x", "s", "l", "w", "t", "c", "h", "r", "z")
    rows = [
        (1, make_text(1), "en", "a", 3, *clash),
        (2, None, None, None, None, *[None] * 15),
        (3, "", "en", "b", 0, *clash),
        (3, "", "en", "b", 0, *clash),
        (4, " \n\t ", "en", "b", 4, *clash),
        (5, make_text(2), "en", "b", 4, *clash),
        (5, make_text(2), "en", "b", 4, *clash),
        (None, make_text(3), "en", "c", 4, *clash),
        (6, make_text(3), "en", None, 4, *clash),
        (7, make_text(4, 20_000), "en", "a", 4, *clash),
        (8, "x" * 200_000, "en", "a", 4, *clash),
        (9, "word", "en", "a", 4, *clash),
    ]
    return spark.createDataFrame(rows, ODD_SCHEMA)


@pytest.fixture(scope="session")
def copies(spark):
    """Texts with exact copies and copies with few and with many changes."""
    rows = []
    for base in range(12):
        text = make_text(100 + base)
        rows.append((base * 10, text))
        rows.append((base * 10 + 1, text))
        rows.append((base * 10 + 2, edited(text, base, 1)))
        rows.append((base * 10 + 3, edited(text, base + 50, 2)))
        rows.append((base * 10 + 4, edited(text, base + 90, 12)))
    rows += [(1000 + i, make_text(500 + i)) for i in range(20)]
    return spark.createDataFrame(rows, "doc_id long, text string")
