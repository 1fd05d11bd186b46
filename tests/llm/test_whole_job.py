"""The whole job of each operator, where a shorter one once passed."""

from __future__ import annotations

import math
import random

import corpus_pipeline
import numpy as np
import pytest

from kinfold.llm import hamming, html_text, language, licenses, packing
from kinfold.llm.vocabularies import tokenizer


def test_model_keeps_every_word_and_gram_of_the_sample(spark):
    names = [f"{a}{b}{c}{d}" for a in "bdfgk" for b in "aeiou" for c in "lmnrstvwxz" for d in "abcdefghijklmnopqrstuvwxyz"]
    words = [f"{n}{m}" for n in names for m in ("op", "uq", "yt")]
    texts = [(i, " ".join(words[i::30]), "en") for i in range(30)] + [(100, "mot rare", "fr")]
    model = language.train(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    assert len(words) > 15_000 and set(model.words) == {*words, "mot", "rare"}
    grams = {f"<{w}>"[i : i + n] for w in (*words, "mot", "rare") for n in range(1, 6) for i in range(len(w) + 3 - n)}
    assert set(model.grams) == grams
    en = model.scores([[words[0]], []])[0]
    assert en.argmax() == 0 and abs(en[0] - math.log(1.5 / (len(words) + 0.5 * (len(words) + 2) + 1))) < 1e-9


def test_stage_links_texts_of_a_similarity_of_080(spark):
    texts = [(1, [f"w{i}" for i in range(500)])]
    texts.append((2, [f"x{i}" if i % 50 == 25 else w for i, w in enumerate(texts[0][1])]))  # 446 of 546 shingles
    texts.append((3, [f"y{i}" if i % 38 == 19 else w for i, w in enumerate(texts[0][1])]))  # 431 of 561
    rows = [(i, " ".join(t), "en", "a", 1) for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3]
    assert hamming.near_classes(docs).filter("kept").count() == 3


def test_bands_miss_few_pairs_and_share_a_key():
    assert hamming.bands(85) == hamming.Bands(85, hamming.CHUNKS, hamming.PER_CHUNK)
    pick = np.random.default_rng(2)
    for similar in (70, 75, 80, 85, 90, 100):
        cut = hamming.bands(similar)
        assert cut.missed() <= hamming.MISSED
        for _ in range(50):
            differ = np.zeros(cut.values, bool)
            differ[pick.choice(cut.values, cut.distance, replace=False)] = True
            chunk, out = divmod(hamming.first_key(differ, cut), cut.per_chunk)
            assert differ.reshape(cut.chunks, -1)[chunk].sum() == differ.reshape(cut.chunks, -1)[chunk, out]


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above, row = row, [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
    return row[-1]


def test_copies_of_a_notice_do_not_hide_each_other():
    pick = random.Random(5)
    filler = "the of under to and work this file in any or word other text".split()
    known = {n: licenses.words(t) for n, t in licenses.NOTICES.items()}
    for name in ("MIT", "GPL-3.0", "MIT-text", "Apache-2.0-notice"):
        notice = known[name]
        for copies in (1, 2, 3):
            text, at = [pick.choice(filler) for _ in range(300)], []
            for _ in range(copies):
                loose = sorted({*range(len(notice))} - {*licenses.telling(notice)})  # a short notice needs its name
                drop = set(pick.sample(loose, len(notice) // 10))
                copy = [w for i, w in enumerate(notice) if i not in drop]
                copy[len(copy) // 2 : len(copy) // 2] = ["foreign"] * 20  # a break inside
                at.append((len(text), len(text) + len(copy)))
                text += copy + [pick.choice(filler) for _ in range(300)]
            found = [m for m in licenses.matches(" ".join(text), {name: notice}) if m[0] == name]
            for a, b in at:
                mine = [m for m in found if m[2] < b and a < m[3]]
                assert len(mine) == 1 and mine[0][1] >= longest_common(text[a:b], notice) / len(notice)
                assert mine[0][1] == longest_common(text[mine[0][2] : mine[0][3]], notice) / len(notice)


def test_two_equal_lines_in_the_middle(spark):
    line = "Released under the MIT License."
    text = f"the start of a file {line} and under the rest of it {line} the end of the work"
    found = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (found.license, found.coverage, found.first_word, found.n_words) == ("MIT", 1.0, 5, 5)


def test_plain_alignment_is_a_longest_one():
    pick = random.Random(6)
    for _ in range(300):
        a, b = ([pick.choice("abcd") for _ in range(pick.randrange(12))] for _ in range(2))
        pairs = licenses.common(a, b)
        assert len(pairs) == longest_common(a, b) and all(a[x] == b[y] for x, y in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        if b:
            assert licenses.Sequence(b).reach([*enumerate(a)] if set(a) <= set(b) else [], range(len(a) if set(a) <= set(b) else 0), len(b))[0] == (len(pairs) if set(a) <= set(b) else 0)


LONG = "".join(f"<p>{n} {'words of a paragraph that is long enough ' * 5}</p>" for n in range(6))
MENU = "".join(f"<li><a href=/{n}>Link number {n}</a></li>" for n in range(20))


@pytest.mark.parametrize(
    ("body", "kept"),
    [
        (f"<div><h1>Headline</h1><div>{LONG}</div></div>", ["Headline"]),
        (f"<article><div><h1>Headline</h1><div>{LONG}</div></div></article>", ["Headline"]),
        (f"<div><h1>Headline</h1><div><div>{LONG}</div></div></div>", ["Headline"]),
        (f"<h1>Headline</h1><div>{LONG}</div>", ["Headline"]),
        (f"<div><div>{LONG}</div><div><ul><li>one<li>two<li>three</ul></div></div>", ["one", "two", "three"]),
        (f"<div><div>{LONG}</div><section><p>short</p><p>bits</p></section></div>", ["short", "bits"]),
        (f"<div>{LONG}</div><div><p>{'Second part of the article ' * 8}</p><p>{'and its end ' * 20}</p></div>", ["Second part", "and its end"]),
    ],
)
def test_sparse_and_second_parts_of_an_article_stay(body, kept):
    for page in (f"<body>{body}</body>", f"<body><div><div><ul>{MENU}</ul></div><div>{body}</div></div></body>"):
        text = html_text.main_text(page)
        assert all(k in text for k in kept) and text.count("long enough") == 30 and "Link" not in text


def test_every_notice_is_returned_and_names_are_told_apart(spark):
    mit, cc = licenses.NOTICES["MIT"], licenses.NOTICES["CC-BY-4.0"]
    gpl = licenses.NOTICES["GPL-3.0"]
    texts = [
        (1, f"code: {mit} {licenses.NOTICES['Apache-2.0-notice']} data: {cc} more code: {mit}"),
        (2, "Released under the BSD License."),
        (3, "Licensed under CC BY-SA 4.0."),
        (4, gpl.replace("version 3", "version 2")),
        (5, gpl.replace("version 3", "version 3.0")),
        (6, licenses.NOTICES["CC-BY-NC-4.0"]),
        (7, gpl.replace("General", "Lesser General")),
    ]
    found = {r.id: r for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    names = {i: [m.license for m in r.matches] for i, r in found.items()}
    assert names[1] == ["MIT", "Apache-2.0", "Apache-2.0-notice", "CC-BY-4.0", "MIT"]
    assert found[1].license == "Apache-2.0-notice" and found[1].matches[0].first_word == 1
    assert all(m.coverage == 1.0 for m in found[1].matches)
    assert names[2] == names[3] == names[4] == names[7] == [] and found[4].license is None
    assert names[5] == ["GPL-3.0"] and names[6] == ["CC-BY-NC-4.0"]


def test_every_source_has_its_own_queue_at_any_number(spark, monkeypatch):
    rows = [(i, f"word {i} " * (i % 7 * 20 + 1), f"s{i % 9 * (i % 2)}") for i in range(120)]
    rows.append((500, None, None))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3, "doc_id")

    def packed():
        found = packing.pack(df, tokenizer("byte_bpe_50k.json"), length=64, window=256)
        return sorted(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in found.collect())

    few = packed()
    monkeypatch.setattr(packing, "MAX_QUEUES", 2)
    assert packed() == few
    assert {r[7] for r in few} == {r[2] or "" for r in rows}


def test_stage_keeps_texts_with_letters_where_no_language_is_known(spark):
    rows = [(1, "one two", None), (2, "12 !!", None), (3, None, None), (4, "\u00e9", None), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.language_id(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4]
