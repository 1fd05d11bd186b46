"""Licenses of like wording, and the alignment against a plain recursive one."""

import random

import pytest

from kinfold.llm import licenses
from kinfold.llm.licenses import ALL_NOTICES, aligned, matches, telling, words

KNOWN = {name: words(text) for name, text in ALL_NOTICES.items()}


def best(text):
    found = licenses.best_match(text, KNOWN)
    return found and found[0]


@pytest.mark.parametrize("name", ALL_NOTICES)
def test_every_notice_is_told_from_its_likes(name):
    text = ALL_NOTICES[name]
    assert best(text) == name
    assert best(f"Words of another text stand here. {text} And some words more.") == name
    assert best(f"{text} {' '.join(f'word{i}' for i in range(300))} {text}") == name
    upper = text.upper().replace(" ", "\n * ")
    assert best(upper) == name


def test_copyleft_versions_and_variants():
    gpl = ALL_NOTICES["GPL-3.0-notice"]
    only = {"GPL-3.0-notice": KNOWN["GPL-3.0-notice"], "GPL-3.0": KNOWN["GPL-3.0"]}
    for other in ("GPL-2.0-notice", "LGPL-3.0-notice", "LGPL-2.1-notice", "AGPL-3.0-notice"):
        assert matches(ALL_NOTICES[other], only) == []
        assert best(ALL_NOTICES[other]) == other
    found = {m[0] for m in matches(gpl + " " + ALL_NOTICES["AGPL-3.0-notice"], KNOWN)}
    assert {"GPL-3.0-notice", "AGPL-3.0-notice"} <= found
    assert not found & {"GPL-2.0-notice", "LGPL-3.0-notice", "LGPL-2.1-notice"}
    assert best(ALL_NOTICES["BSD-2-Clause-text"]) == "BSD-2-Clause-text"
    assert matches(ALL_NOTICES["BSD-2-Clause-text"], {"BSD-3": KNOWN["BSD-3-Clause-text"]}) == []


def test_usual_lines():
    assert best("This project is MIT licensed.") == "MIT-licensed"
    assert best("This file is licensed under Apache License 2.0") == "Apache-2.0-line"
    assert best("SPDX-License-Identifier: Apache-2.0") == "SPDX-Apache-2.0"
    for text in ("", "The license of the software is free to use by the public.", "MIT and Apache 2.0 are names."):
        assert best(text) is None


def test_telling_words_do_not_hang_on_the_size_of_a_notice():
    assert [KNOWN["GPL-3.0-notice"][i] for i in telling(KNOWN["GPL-3.0-notice"])] == ["gnu", "general", "public", "3"]
    assert [KNOWN["GPL-3.0"][i] for i in telling(KNOWN["GPL-3.0"])] == ["gnu", "general", "public", "3"]
    assert telling(words("Released under the Frobnicate License.")) == [3]
    assert telling(KNOWN["MIT-text"]) == [] and telling([]) == []


def plain(text, notice):
    """Patience alignment, recursively: ends alike, unique words in a longest common order, gaps."""
    if not text or not notice:
        return 0
    if text[0] == notice[0]:
        return 1 + plain(text[1:], notice[1:])
    if text[-1] == notice[-1]:
        return 1 + plain(text[:-1], notice[:-1])
    once = [w for w in notice if notice.count(w) == 1 and text.count(w) == 1]
    if not once:
        length = [[0] * (len(notice) + 1) for _ in range(len(text) + 1)]
        for i, w in enumerate(text):
            for j, v in enumerate(notice):
                length[i + 1][j + 1] = length[i][j] + 1 if w == v else max(length[i][j + 1], length[i + 1][j])
        return length[-1][-1]
    chains: list[list[str]] = []
    for w in once:
        at = text.index(w)
        before = [c for c in chains if text.index(c[-1]) < at]
        chains.append([*max(before, key=len, default=[]), w])
    chain = max(chains, key=len)
    total, i, j = 0, 0, 0
    for w in chain:
        x, y = text.index(w), notice.index(w)
        total += 1 + plain(text[i:x], notice[j:y])
        i, j = x + 1, y + 1
    return total + plain(text[i:], notice[j:])


def test_alignment_is_patient():
    pick = random.Random(3)
    same = 0
    for _ in range(400):
        notice = [pick.choice("abcdefghijkl") for _ in range(pick.randrange(0, 14))]
        text = [w for w in notice if pick.random() < 0.8]
        for _ in range(pick.randrange(0, 6)):
            text.insert(pick.randrange(len(text) + 1), pick.choice("abcdefghijklxyz"))
        pairs = aligned(text, notice)
        assert all(text[i] == notice[j] for i, j in pairs)
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False))
        same += len(pairs) == plain(text, notice)
    assert same >= 380  # equally long runs of anchors may be chosen differently
