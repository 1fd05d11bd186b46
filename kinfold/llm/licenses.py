"""License scans by patience alignment of texts with known notices.

A notice stands wherever a stretch of the text, no wider than the notice plus
insertions, has enough of its words in order: the longest common subsequence with the
notice finds each such place, from left to right, and one place ends where the next
begins, so copies do not hide each other. Inside a place, words that occur once in the
notice and once in the text are anchors; the longest run of anchors that keeps their
order is taken, and the gaps between them are aligned in the same way, where more
words are unique, or plainly where none is. Coverage is the share of the notice's
words that are aligned. Every place of every notice is a match; of a short notice the
words that name the license and its version must all be aligned.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .texts import pieces, slices, strings

COVERED = 0.8  # least share of a notice's words
INSERTED = 60  # foreign words that may stand in a place of a notice, besides as many as it has
WORD = re.compile(r"[a-z0-9]+(?:[.-][0-9]+)*")

# Wordings of public license notices.
NOTICES = {
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The "
        "above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software."
    ),
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        "an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
}
# The notices above and further ones.
ALL_NOTICES = NOTICES | {
    "GPL-2.0-notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version."
    ),
    "LGPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version."
    ),
    "LGPL-2.1-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at "
        "your option) any later version."
    ),
    "AGPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version."
    ),
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "BSD-2-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution."
    ),
    "BSD-3-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior "
        "written permission."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "BSD": "Released under the BSD License.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "SPDX-MIT": "SPDX-License-Identifier: MIT",
    "SPDX-Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "MIT-line": "This project is licensed under the MIT License.",
    "MIT-licensed": "This project is MIT licensed.",
    "Apache-2.0-line": "Licensed under Apache License 2.0.",
}


# Words that name a license, or tell it from those of like wording.
NAMES = set(
    "affero apache artistic boost bsd cc commons creative eclipse endorse general gnu gpl isc lesser library mit mozilla "
    "nc nd public sa spdx unlicense zlib".split()
)
# Words of notices that name no license, where a notice has none of those above.
WORDING = set(
    "a an all and any as by-line code content distributed file following in is it its licence license licensed made "
    "of or permitted program project provided published released reserved rights shared software source terms the "
    "this to under use used version with work you your available".split()
)
VARIANTS = {"sa", "nd", "nc", "lesser", "library", "affero"}  # make another license of the name they stand in
VERSION = re.compile(r"v?([0-9]+(?:\.[0-9]+)*?)(?:\.0)*")  # 3, 3.0 and v3 are one


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def aligned(text: list[str], notice: list[str]) -> list[tuple[int, int]]:
    """Pairs of places (in the text, in the notice) that the alignment matches, in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(notice))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == notice[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == notice[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        chain = longest_increasing(unique_pairs(text, a, b, notice, c, d))
        if not chain:
            out += [(a + x, c + y) for x, y in common(text[a:b], notice[c:d])]
            continue
        edges = [(a - 1, c - 1), *chain, (b, d)]
        out += chain
        todo += [(x + 1, z, y + 1, w) for (x, y), (z, w) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def unique_pairs(text: list[str], a: int, b: int, notice: list[str], c: int, d: int) -> list[tuple[int, int]]:
    """Places of the words that are unique in both ranges, in the notice's order."""
    in_notice = Counter(notice[c:d])
    in_text = Counter(w for w in text[a:b] if w in in_notice)
    place = {w: i for i, w in enumerate(text[a:b], a) if in_text.get(w) == 1}
    return [(place[w], i) for i, w in enumerate(notice[c:d], c) if in_notice[w] == 1 and w in place]


def longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs whose first numbers rise, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []  # index of each pile's top
    below: list[int] = []
    for i, (x, _) in enumerate(pairs):
        pile = bisect_left(tops, x)
        below.append(piles[pile - 1] if pile else -1)
        tops[pile : pile + 1] = [x]
        piles[pile : pile + 1] = [i]
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = below[i]
    return out[::-1]


def common(text: list[str], notice: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence."""
    rows, at = [], [0] * (len(notice) + 1)
    wanted = set(notice)
    words = [(i, w) for i, w in enumerate(text) if w in wanted]
    for _, w in words:
        above, at = at, [0]
        for j, v in enumerate(notice):
            at.append(above[j] + 1 if v == w else max(above[j + 1], at[j]))
        rows.append(above)
    out, j, best = [], len(notice), at
    for (i, w), above in zip(reversed(words), reversed(rows), strict=True):
        # The word is in it only if the rows before cannot do as well without it.
        if best[j] > above[j]:
            while notice[j - 1] != w or best[j - 1] == best[j]:
                j -= 1
            j -= 1
            out.append((i, j))
        best = above
    return out[::-1]


class Sequence:
    """Lengths of longest common subsequences with a notice, in one number's bits."""

    def __init__(self, notice: list[str]):
        self.size = len(notice)
        self.full = (1 << self.size) - 1
        self.bits: dict[str, int] = {}
        for i, w in enumerate(notice):
            self.bits[w] = self.bits.get(w, 0) | 1 << i
        self.back = {w: int(f"{b:0{self.size}b}"[::-1], 2) for w, b in self.bits.items()}

    def reach(self, hits: list[tuple[int, str]], order: range, need: int, back: bool = False) -> tuple[int, int]:
        """The longest length up to `need` over these hits, and the first hit it is reached at."""
        bits, state, longest, at = self.back if back else self.bits, self.full, 0, -1
        for i in order:
            met = state & bits[hits[i][1]]
            if met:
                state = (state + met | state - met) & self.full
                if self.size - state.bit_count() > longest:
                    longest, at = longest + 1, i
                    if longest >= need:
                        break
        return longest, at


def places(text: list[str], notice: list[str], least: float) -> list[tuple[int, int, int]]:
    """Ranges of the text where the notice stands, in order and apart, and how many of
    its words can be aligned there."""
    sequence, wanted, need = Sequence(notice), Counter(notice), max(1, math.ceil(least * len(notice) - 1e-9))
    wide = 2 * len(notice) + INSERTED
    hits = [(i, w) for i, w in enumerate(text) if w in wanted]

    def tightest(low: int) -> tuple[int, int] | None:
        """The first and last hit of the stretch from `low` on that ends first."""
        have: Counter = Counter()
        inside, right = 0, low
        for left in range(low, len(hits)):
            while right < len(hits) and hits[right][0] < hits[left][0] + wide:
                have[hits[right][1]] += 1
                inside += have[hits[right][1]] <= wanted[hits[right][1]]
                right += 1
            if inside >= need:
                longest, end = sequence.reach(hits, range(left, right), need)
                if longest >= need:
                    return sequence.reach(hits, range(end, left - 1, -1), need, True)[1], end
            inside -= have[hits[left][1]] <= wanted[hits[left][1]]
            have[hits[left][1]] -= 1
        return None

    out: list[tuple[int, int, int]] = []
    low = 0
    found = tightest(low)
    while found:
        begin, end = found
        after = tightest(end + 1)
        stop = after[0] if after else len(hits)
        while low < begin and hits[low][0] <= hits[end][0] - wide:
            low += 1
        while stop > end + 1 and hits[stop - 1][0] >= hits[begin][0] + wide:
            stop -= 1
        longest, last = sequence.reach(hits, range(low, stop), len(notice))
        first = sequence.reach(hits, range(last, low - 1, -1), longest, True)[1]
        out.append((hits[first][0], hits[last][0] + 1, longest))
        low = last + 1
        found = after if after and after[0] >= low else tightest(low)
    return out


def telling(notice: list[str]) -> list[int]:
    """Places of the words that a match must have: the first of each word that names the
    license, and of the version behind one; without a name the words that are not common
    wording, should these be a third of the notice at most."""
    out: list[int] = []
    library = "gnu" in notice
    for i, w in enumerate(notice):
        behind = any(j in out or notice[j] in ("version", "v") for j in (i - 1, i - 2) if j >= 0)
        named = w in NAMES and (w != "library" or (library and notice[i - 1] == "gnu"))
        named = named or w.partition("-")[0] in NAMES or (w == "by" and i > 0 and notice[i - 1] == "cc")
        if (named or (behind and VERSION.fullmatch(w))) and w not in {notice[j] for j in out}:
            out.append(i)
    if not out:
        rare = [i for i, w in enumerate(notice) if w not in WORDING]
        out = rare if 3 * len(rare) <= len(notice) else []
    return out


def matches(text: str, notices: Mapping[str, list[str]], least: float = COVERED) -> list[tuple[str, float, int, int]]:
    """(name, coverage, first word, word after the last) of each place of each notice, by place."""
    own = words(text)
    found = []
    for name, notice in notices.items():
        need = telling(notice)
        if need:
            found += [(name, *m) for m in named_matches(own, notice, need, least)]
            continue
        for a, b, _ in places(own, notice, least):
            pairs = aligned(own[a:b], notice)
            if len(pairs) >= least * len(notice) - 1e-9:
                found.append((name, len(pairs) / len(notice), a + pairs[0][0], a + pairs[-1][0] + 1))
    return sorted(found, key=lambda m: (m[2], m[3], m[0]))


def same(word: str) -> str:
    found = VERSION.fullmatch(word)
    return found[1] if found else word


def named_matches(own: list[str], notice: list[str], need: list[int], least: float) -> Iterator[tuple[float, int, int]]:
    """(coverage, first word, word after the last) of each place where all words at `need`
    stand in order, with no variant's word between, and enough others around them."""
    wanted, wide = [same(notice[i]) for i in need], 2 * len(notice) + INSERTED
    spots: dict[str, list[int]] = {w: [] for w in wanted}
    for i, w in enumerate(own):
        if (w := same(w)) in spots:
            spots[w].append(i)
    names: list[list[int]] = []
    for i in spots[wanted[0]]:
        at = [i]
        for w in wanted[1:]:
            later = bisect_right(spots[w], at[-1])
            if later < len(spots[w]):
                at.append(spots[w][later])
        if len(at) < len(wanted):
            break
        if names and names[-1][-1] == at[-1]:
            names.pop()  # begins later, ends alike
        names.append(at)
    done = 0
    for n, at in enumerate(names):
        foreign = {own[i] for i in range(at[0], at[-1]) if i not in at}
        if at[0] < done or at[-1] - at[0] >= wide or foreign & VARIANTS:
            continue
        pairs = [*zip(at, need, strict=True)]
        for (x, y), (z, w) in zip(pairs[: len(at)], pairs[1 : len(at)], strict=False):
            pairs += [(x + 1 + i, y + 1 + j) for i, j in aligned(own[x + 1 : z], notice[y + 1 : w])]
        # The words before are looked for backwards, so that the nearest are taken.
        before, after = need[0], len(notice) - need[-1] - 1
        low = max(done, at[0] - 2 * before - INSERTED // 2)
        back = aligned(own[low : at[0]][::-1], notice[:before][::-1])
        pairs += [(at[0] - 1 - i, before - 1 - j) for i, j in back]
        follow = names[n + 1][0] if n + 1 < len(names) and names[n + 1][0] > at[-1] else len(own)
        high = min(follow, at[-1] + 1 + 2 * after + INSERTED // 2)
        ahead = aligned(own[at[-1] + 1 : high], notice[need[-1] + 1 :])
        pairs += [(at[-1] + 1 + i, need[-1] + 1 + j) for i, j in ahead]
        if len(pairs) >= least * len(notice) - 1e-9:
            done = max(pairs)[0] + 1
            yield len(pairs) / len(notice), min(pairs)[0], done


def best_match(text: str, notices: Mapping[str, list[str]], least: float = COVERED) -> tuple[str, float, int, int] | None:
    """The best of the matches."""
    return best_of(matches(text, notices, least), notices)


def best_of(
    found: list[tuple[str, float, int, int]], notices: Mapping[str, list[str]]
) -> tuple[str, float, int, int] | None:
    """The match with the highest coverage; of equal ones the longest notice, then the first by
    name, then the first place."""
    return min(found, key=lambda m: (-m[1], -len(notices[m[0]]), m[0], m[2]), default=None)


def scan(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    notices: Mapping[str, str] = NOTICES,
    least: float = COVERED,
) -> DataFrame:
    """(id, license, coverage, first_word, n_words, matches), a row per input row: the notice
    that covers best, and where; `matches` has the same of every place of every notice,
    by place. Without a notice of `least` coverage license is null, the rest 0 and
    `matches` empty; null and empty texts have none, an empty table gives no rows. Texts of
    any length are read whole. Other columns are ignored."""
    one = "license string, coverage double, first_word long, n_words long"
    fields = one.replace(" ", ": ").replace(",:", ",")
    fields = f"{one}, matches array<struct<{fields}>>"
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), *T.StructType.fromDDL(fields)])
    parts = ("license", "coverage", "first_word", "n_words")
    kind = pa.list_(pa.struct([*zip(parts, (pa.string(), pa.float64(), pa.int64(), pa.int64()), strict=True)]))
    known = {name: words(text) for name, text in notices.items() if words(text)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = {name: least * len(notice) for name, notice in known.items()}
        vocabulary = {w for notice in known.values() for w in notice}
        number = {w: i for i, w in enumerate(sorted(vocabulary))}
        member = np.zeros((len(known), len(number) + 1), np.int64)
        for row, notice in enumerate(known.values()):
            for w in notice:
                member[row, number[w]] += 1
        needed = np.array([*sizes.values()])
        seen: dict[str, tuple[int, ...]] = {}
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = strings(batch.column("text"))
                found, codes, begins = pieces(texts)
                if len(seen) > 500_000:
                    seen.clear()
                for piece in found:
                    if piece not in seen:
                        seen[piece] = tuple({number[w] for w in words(piece) if w in number})
                hit = np.array([bool(seen[p]) for p in found], bool)[codes] if found else np.zeros(0, bool)
                out, every = [], []
                spots = np.flatnonzero(hit)
                edges = np.searchsorted(spots, begins)
                for row, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
                    # What notices could be covered by the different words the text has.
                    have = {n for c in np.unique(codes[spots[low:high]]).tolist() for n in seen[found[c]]}
                    reach = member[:, sorted(have)].sum(axis=1) if have else np.zeros(len(known))
                    names = [name for name, ok in zip(known, reach >= needed, strict=True) if ok]
                    match = matches(texts[row].as_py(), {n: known[n] for n in names}, least) if names else []
                    out.append(best_of(match, known) or (None, 0.0, 0, 0))
                    every.append([dict(zip(parts, (n, c, a, b - a), strict=True)) for n, c, a, b in match])
                columns = [*zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"),
                        pa.array(columns[0], pa.string()),
                        pa.array(columns[1], pa.float64()),
                        pa.array(columns[2], pa.int64()),
                        pa.array([b - a for a, b in zip(columns[2], columns[3], strict=True)], pa.int64()),
                        pa.array(every, kind),
                    ],
                    names=schema.names,
                )

    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, schema)
