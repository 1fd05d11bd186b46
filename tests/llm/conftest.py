import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Columns of names that operators use inside.
CLASH = "id string, row long, n long, h long, key long, queue string, comp long, kept string, doc string, body string"


def prose(seed: int, n: int) -> str:
    pick = random.Random(seed)
    parts = "an er in th re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve".split()
    words = ["".join(pick.choice(parts) for _ in range(pick.randint(1, 4))) for _ in range(n)]
    return " ".join(words)


def rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, exact and near copies, ties,
    repeated rows and passages that several texts share."""
    shared = prose(1, 70)
    base = prose(2, 300)
    words = base.split()
    near = " ".join([*words[:150], "changed", *words[151:]])
    far = " ".join([*words[:40], *prose(3, 260).split()])
    spaced = base.replace(" ", " \t\n", 5)
    found = [
        (10, base, "en", "a"),
        (11, base, "en", "a"),
        (12, spaced, "en", "b"),
        (13, near, "en", "a"),
        (14, far, "fr", "a"),
        (15, f"{prose(4, 50)} {shared} {prose(5, 60)}", "en", None),
        (16, f"{prose(6, 30)}\n{shared}", None, "a"),
        (17, f"{shared} {prose(7, 20)} {shared}", "fr", "c"),
        (18, None, "en", "a"),
        (19, "", "fr", "b"),
        (20, " \n\t ", None, "a"),
        (21, "12 34 !! ² ½", "en", "a"),
        (22, "one two", "en", "c"),
        (23, "ONE two", "en", "a"),
        (24, prose(8, 12_000), "en", "a"),
        (25, "Éa    naïve \U0001f600 don't  \n \n   x <|endoftext|> y", "fr", "a"),
        (None, prose(9, 80), "fr", "a"),
        (27, prose(10, 90), "fr", "a"),
        (27, prose(10, 90), "fr", "a"),
        (27, prose(11, 15), "fr", "c"),
        (2**40, "aaaa" * 300, "en", "a"),
    ]
    return [(i, t, g, s, None if t is None else len(t)) for i, t, g, s in found]


@pytest.fixture(scope="session")
def raw():
    return [(r[0], r[1]) for r in rows()]


@pytest.fixture(scope="session")
def messy(spark):
    data = [(*r, "x", 7, None, 1, 2, "q", 3, "k", "d", "b") for r in rows()]
    return spark.createDataFrame(data, f"{DOCS}, {CLASH}").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
