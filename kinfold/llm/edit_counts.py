"""Token counts that follow edits without counting a text anew.

A document's pre-tokens are the leaves of a segment tree whose nodes hold the
characters and tokens below them; a leaf holds GROUP pre-tokens. An edit goes
down the tree to the pre-tokens it touches, splits and encodes the text from a
little before it until the cuts fall into step with the old ones, replaces
those pre-tokens, and updates the sums on the way up. Special tokens in a text
are ordinary text here.
"""

from __future__ import annotations

import gc
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_tokens import LATIN, PATTERN, SPACE, rank_encoder
from .texts import kept, pieces, slices, spans, strings, sums

GROUP = 32  # pre-tokens per leaf
LOOK = 2  # characters behind a pre-token that may decide where it ends
SLICE_BYTES = 1 << 20
KNOWN = 150_000  # pieces a worker remembers; results do not depend on it
SPLIT = regex.compile(PATTERN)

Edit = tuple[int, int, str]  # where, how many characters go, what comes instead


class Counts:
    """Numbers of tokens of pre-tokens, remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        self.ranked = rank_encoder(path)
        self.known: dict[str, int] = {}
        self.pieces: dict[str, tuple[list[int], list[int]]] = {}

    def of(self, tokens: list[str]) -> list[int]:
        new = [t for t in dict.fromkeys(tokens) if t not in self.known]
        if len(self.known) + len(new) > KNOWN:
            self.known = {}
            new = [*dict.fromkeys(tokens)]
        if new:
            latin = [t for t in new if self.ranked and (t.isascii() or max(t) < LATIN)]
            self.known.update((t, len(self.ranked.encode_ordinary(t))) for t in latin)
            rest = [t for t in new if t not in self.known]
            coded = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
            self.known.update(zip(rest, map(len, coded), strict=True))
        return [self.known[t] for t in tokens]

    def leaves(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Characters and tokens of all pre-tokens in a row, and where each text's begin."""
        slow = pc.match_substring_regex(texts, f"{SPACE} {SPACE}").to_numpy(zero_copy_only=False)
        found, codes, begins = pieces(pc.if_else(pa.array(slow), "", texts))
        firsts, place = np.unique(codes[begins[:-1]], return_inverse=True)
        codes = codes.astype(np.int64)
        codes[begins[:-1]] = len(found) + place
        keys = [f" {p}" for p in found] + [found[c] for c in firsts]
        whole = texts.filter(pa.array(slow)).to_pylist()
        codes[begins[:-1][slow]] = len(keys) + np.arange(len(whole))
        split = self.split(keys) + [self.split_one(t) for t in whole]
        size = np.array([len(s[0]) for s in split], np.int64)
        chars = np.array([x for s in split for x in s[0]], np.int64)
        tokens = np.array([x for s in split for x in s[1]], np.int64)
        at = spans((np.cumsum(size) - size)[codes], size[codes])
        return chars[at], tokens[at], np.concatenate([[0], np.cumsum(sums(size[codes], begins))])

    def split(self, keys: list[str]) -> list[tuple[list[int], list[int]]]:
        if len(self.pieces) > KNOWN:
            self.pieces = {}
        new = [k for k in keys if k not in self.pieces]
        parts = [SPLIT.findall(k) for k in new]
        flat = self.of([t for p in parts for t in p])
        at = 0
        for key, part in zip(new, parts, strict=True):
            self.pieces[key] = [len(t) for t in part], flat[at : at + len(part)]
            at += len(part)
        return [self.pieces[k] for k in keys]

    def split_one(self, text: str) -> tuple[list[int], list[int]]:
        part = SPLIT.findall(text)
        return [len(t) for t in part], self.of(part)


class CountTree:
    """Segment tree over the pre-tokens of one text."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        groups = max(1, -(-len(chars) // GROUP))
        self.width = 1 << (groups - 1).bit_length()
        self.chars, self.tokens = chars, tokens
        self.changed: dict[int, list[tuple[int, int]]] = {}
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        if len(chars):
            starts = np.arange(0, len(chars), GROUP)
            self.sums[self.width : self.width + groups, 0] = np.add.reduceat(chars, starts)
            self.sums[self.width : self.width + groups, 1] = np.add.reduceat(tokens, starts)
        level = self.width
        while level > 1:
            below = self.sums[level : 2 * level]
            level //= 2
            self.sums[level : 2 * level] = below[::2] + below[1::2]

    @property
    def total(self) -> int:
        return int(self.sums[1, 1])

    def leaf(self, group: int) -> list[tuple[int, int]]:
        """(characters, tokens) of a group's pre-tokens."""
        if group not in self.changed:
            part = slice(group * GROUP, (group + 1) * GROUP)
            self.changed[group] = [*zip(self.chars[part].tolist(), self.tokens[part].tolist(), strict=True)]
        return self.changed[group]

    def find(self, position: int) -> tuple[int, int]:
        """The group that holds a character, and how many characters stand before it."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            left = int(self.sums[node, 0])
            if position >= before + left and node + 1 < 2 * self.width and self.sums[node + 1, 0]:
                before += left
                node += 1
        return node - self.width, before

    def put(self, group: int, leaf: list[tuple[int, int]]) -> None:
        self.changed[group] = leaf
        node = group + self.width
        self.sums[node] = sum(c for c, _ in leaf), sum(t for _, t in leaf)
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def edit(self, old: str, new: str, edit: Edit, counts: Counts) -> int:
        """Take over an edit that made `new` of `old`; the number of pre-tokens encoded."""
        at, gone, put = edit
        shift = len(put) - gone
        # The first pre-token that may differ: those that end LOOK before the edit cannot.
        group, start = self.find(max(0, at - LOOK - 1))
        leaf = self.leaf(group)
        place = 0
        while place < len(leaf) and start + leaf[place][0] + LOOK <= at:
            start += leaf[place][0]
            place += 1
        # Old cuts behind the edit, group by group, until a new cut meets one.
        made: list[str] = []
        position, old_group, old_place, old_cut = start, group, place, start
        while True:
            while old_cut + shift < position or old_cut < at + gone:
                if old_place < len(self.leaf(old_group)):
                    old_cut += self.leaf(old_group)[old_place][0]
                    old_place += 1
                elif old_group + 1 < self.width and old_cut < len(old):
                    old_group, old_place = old_group + 1, 0
                else:
                    break
            if old_cut + shift == position and old_cut >= at + gone and position >= at + len(put):
                break
            hit = SPLIT.match(new, position)
            if hit is None:
                break
            made.append(hit.group())
            position = hit.end()
        fresh = [*zip(map(len, made), counts.of(made), strict=True)]
        if old_group == group:
            self.put(group, leaf[:place] + fresh + leaf[old_place:])
        else:
            rest = self.leaf(old_group)[old_place:]
            for emptied in range(group + 1, old_group):
                self.put(emptied, [])
            self.put(old_group, rest)
            self.put(group, leaf[:place] + fresh)
        return len(made)


def apply(text: str, edit: Edit) -> str:
    at, gone, put = edit
    return text[:at] + put + text[at + gone :]


def count_edited(
    df: DataFrame, edits: Column, tokenizer: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_tokens, n_edited, n_pretokens, n_encoded, edited), a row per input row.

    `edits` is an array of struct<at:long, gone:long, put:string> per row, applied in
    order: at character `at` of the text so far, `gone` characters go and `put`
    comes; both are held within the text, null edits and null texts are empty.
    `n_tokens` counts the text, `n_edited` the text after all edits, `n_encoded`
    the pre-tokens encoded again for them. Other columns are ignored.
    """
    fields = "n_tokens long, n_edited long, n_pretokens long, n_encoded long, edited string"
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), *T.StructType.fromDDL(fields)])
    shape = "array<struct<at:long,gone:long,put:string>>"
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"), edits.cast(shape).alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.freeze()
        counts = kept(("counts", tokenizer), lambda: Counts(tokenizer))
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                texts = strings(batch.column("text"))
                chars, tokens, begins = counts.leaves(texts)
                out = []
                for row, (text, wanted) in enumerate(
                    zip(texts.to_pylist(), batch.column("edits").to_pylist(), strict=True)
                ):
                    part = slice(begins[row], begins[row + 1])
                    tree = CountTree(chars[part], tokens[part])
                    before, encoded = tree.total, 0
                    for edit in held(text, wanted or []):
                        changed = apply(text, edit)
                        encoded += tree.edit(text, changed, edit, counts)
                        text = changed
                    out.append((before, tree.total, int(begins[row + 1] - begins[row]), encoded, text))
                columns = zip(*out, strict=True)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *made], names=schema.names)

    return rows.mapInArrow(run, schema)


def held(text: str, edits: Sequence[dict]) -> Iterator[Edit]:
    """The edits with places and lengths held within the text as it is by then."""
    length = len(text)
    for edit in edits:
        if edit is None:
            continue
        at = min(max(0, edit["at"] or 0), length)
        gone = min(max(0, edit["gone"] or 0), length - at)
        put = edit["put"] or ""
        length += len(put) - gone
        yield at, gone, put


def sample_edits(text: Column) -> Column:
    """Three edits of a text, as a user might make them: a word put in the middle, a
    piece cut out at a third, and a replacement at the end."""
    n = F.length(F.coalesce(text, F.lit("")))

    def edit(at: Column, gone: int, put: Column) -> Column:
        return F.struct(at.cast("long").alias("at"), F.lit(gone).cast("long").alias("gone"), put.alias("put"))

    first = F.coalesce(F.substring_index(F.substring(text, 1, 40), " ", 1), F.lit(""))
    return F.array(
        edit(F.floor(n / 2), 0, F.concat(F.lit(" "), first)),
        edit(F.floor(n / 3), 17, F.lit("")),
        edit(F.greatest(n - 25, F.lit(0)), 25, F.lit("the end.\n")),
    )
