"""More languages than are scored at a time."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kinfold.llm import language
from kinfold.llm.texts import pieces

COUNT = 2 * language.BLOCK + 88
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def word(i: int, seed: int) -> str:
    """A word of its own for every language, all of the same letters."""
    n = i * 7919 + seed * 104729 + 26**4
    return "".join(LETTERS[n // 26**k % 26] for k in range(5))


def texts() -> list[tuple]:
    return [(i, f"{word(i, 1)} {word(i, 2)} same {word(i, 3)}", f"lang{i:04d}") for i in range(COUNT)]


def test_any_number_of_languages_is_learned_and_told_apart(spark):
    docs = spark.createDataFrame(texts(), "doc_id long, text string, lang string")
    model = language.train(docs)
    assert model.languages == sorted(lang for _, _, lang in texts())
    found = language.identify(docs, model).join(docs, F.col("id") == F.col("doc_id"))
    assert found.filter("lang_pred = lang").count() == COUNT
    assert found.filter("score <= 0 OR score > 1").count() == 0
    # A word that all have is a tie of all; the first by name wins.
    tie = spark.createDataFrame([(1, "same"), (2, None), (3, "12")], "doc_id long, text string")
    rows = {r.id: (r.lang_pred, r.score) for r in language.identify(tie, model).collect()}
    assert rows[1][0] == "lang0000" and math.isclose(rows[1][1], 1 / COUNT, rel_tol=1e-6)
    assert rows[2] == rows[3] == ("und", 0.0)


def test_blocks_of_languages_give_what_one_block_gives(spark):
    docs = spark.createDataFrame(texts()[:90], "doc_id long, text string, lang string")
    model = language.train(docs)
    found = pieces(pa.array([t for _, t, _ in texts()[:120]] + ["same", "", "x1 abc", f"{word(80, 1)} {word(3, 2)}"]))
    whole = language.most_likely(model, [language.Scores(0, 90, 1000)], *found)
    for width in (1, 7, 45, 89):
        blocks = [language.Scores(b, min(b + width, 90), 5) for b in range(0, 90, width)]
        for _ in range(2):  # the second time with what the first remembered
            parts = language.most_likely(model, blocks, *found)
            assert np.array_equal(whole[0], parts[0])
            assert np.allclose(whole[1], parts[1], rtol=1e-9)
            assert np.array_equal(whole[2], parts[2])
