"""Byte-pair encoding of words with end marks by a walk over a prefix trie.

Distinct words are put in a trie of their symbols. The state of a trie node is
the last token of the encoding of the path to it: the one token that ends the
path and may stand after the state of the node where that token begins. It is
found once per node, whatever the number of words below it, and a word's ids
are read off by following the states back from its end.

Two neighbouring tokens may stand side by side if merging their symbols alone
gives just these two; a sequence of tokens is an encoding if all its neighbours
may, which makes the state unique.
"""

from __future__ import annotations

import gc
import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .texts import kept, pieces, slices, strings, sums

END = "</w>"
KNOWN_PIECES = 400_000  # pieces a worker remembers; results do not depend on it
KNOWN_PAIRS = 1_000_000  # likewise for token pairs


Ending = tuple[tuple[int, int], ...]  # (token, its length), longest first
State = tuple[int, int, int]


class TrieEncoder:
    """Encodes words with the merges of a tokenizer file (BPE with an end mark)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END:
            raise ValueError("needs a BPE tokenizer with end-of-word marks")
        self.ids: dict[str, int] = model["vocab"]
        self.names = {i: name for name, i in self.ids.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, self.special)))
        self.names.update({i: name for name, i in self.special.items()})
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.letters = byte_letters()
        # Tokens that merging can make at all: their own symbols merge into just them.
        self.inner = {n: i for n, i in self.ids.items() if not n.endswith(END) and self.merge(list(n)) == [n]}
        self.final = {
            n[: -len(END)]: i
            for n, i in self.ids.items()
            if n.endswith(END) and n != END and self.merge(symbols(n[: -len(END)])) == [n]
        }
        self.final_ids = set(self.final.values())
        self.beside: dict[int, bool] = {}
        self.suffixes = SuffixTokens(self.inner, self.final)

    def merge(self, parts: list[str]) -> list[str]:
        """Plain merging, lowest rank first; used on single tokens and pairs only."""
        ranks = self.ranks
        while len(parts) > 1:
            best, pair = min((ranks.get(p, len(ranks)), p) for p in zip(parts, parts[1:], strict=False))
            if best == len(ranks):
                return parts
            merged, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    merged.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    merged.append(parts[i])
                    i += 1
            parts = merged
        return parts

    def may_follow(self, left: int, right: int) -> bool:
        a, b = self.names[left], self.names[right]
        tail = symbols(b[: -len(END)]) if b.endswith(END) and right in self.final_ids else list(b)
        if len(self.beside) >= KNOWN_PAIRS:
            self.beside.clear()
        known = self.beside[left << 20 | right] = self.merge(list(a) + tail) == [a, b]
        return known

    def last_token(self, ending: Ending, states: list[State], end: int) -> tuple[int, int]:
        """(token, where it begins): of the tokens that may end a path of length
        `end`, the one that may follow the state of the node where it begins."""
        beside = self.beside
        for token, length in ending:
            start = end - length
            if not start:
                return token, 0
            left = states[start][0]
            known = beside.get(left << 20 | token)
            if known is None:
                known = self.may_follow(left, token)
            if known:
                return token, start
        raise ValueError("no token ends the path")

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of each distinct word (in byte letters).

        Sorted words visit the trie depth first: the states of the prefix that
        a word shares with the one before it stay, only new nodes are worked out.
        """
        out: dict[str, list[int]] = {}
        step, inner, final = self.suffixes.step, self.suffixes.inner, self.suffixes.final
        states: list[State] = [(-1, 0, 0)]  # last token, where it begins, node of the suffix table
        before = ""
        for word in sorted(set(words)):
            if not word:
                out[word] = []
                continue
            last = len(word) - 1
            same = min(last, len(states) - 1)
            while word[:same] != before[:same]:
                same -= 1
            del states[same + 1 :]
            for end in range(same + 1, last + 1):
                node = step(states[end - 1][2], word[end - 1])
                states.append((*self.last_token(inner[node], states, end), node))
            token, at = self.last_token(final[step(states[last][2], word[last])], states, last + 1)
            ids = [token]
            while at:
                token, at, _ = states[at]
                ids.append(token)
            out[word] = ids[::-1]
            before = word
        return out

    def words(self, piece: str) -> list[str | int]:
        """A piece of text as words in byte letters and ids of special tokens."""
        found: list[str | int] = []
        at = 0
        if "<|" in piece:
            for hit in self.special_pattern.finditer(piece):
                found += self.plain(piece[at : hit.start()])
                found.append(self.special[hit.group()])
                at = hit.end()
        return found + self.plain(piece[at:])

    def plain(self, piece: str) -> list[str]:
        # Python lowers a final sigma in its own way, so only ASCII is lowered here.
        if piece.isascii() and piece.isprintable():
            return self.split.findall(piece.lower())
        return [self.spell(w) for w in self.split.findall(self.normalizer.normalize_str(piece))]

    def spell(self, word: str) -> str:
        return "".join(map(self.letters.__getitem__, word.encode()))

def symbols(word: str) -> list[str]:
    return [*word[:-1], word[-1] + END]


class SuffixTokens:
    """For each path of letters, the tokens that end it, longest first.

    A node is the longest end of a path that begins some token; `step` goes on
    by a letter, falling back to shorter ends where the longest has no such branch.
    """

    def __init__(self, inner: dict[str, int], final: dict[str, int]):
        self.branches: list[dict[str, int]] = [{}]
        self.inner: list[Ending] = [()]
        self.final: list[Ending] = [()]
        self.shorter = [0]
        level = {"": 0}
        names = sorted({*inner, *final})
        for length in range(1, max(map(len, names), default=0) + 1):
            reached: dict[str, int] = {}
            for name in names:
                if len(name) >= length and name[:length] not in reached:
                    path = name[:length]
                    parent = level[path[:-1]]
                    fallback = self.step(self.shorter[parent], path[-1]) if parent else 0
                    node = reached[path] = len(self.branches)
                    self.branches.append({})
                    self.shorter.append(fallback)
                    for table, ids in ((self.inner, inner), (self.final, final)):
                        own = ((ids[path], length),) if path in ids else ()
                        table.append(own + table[fallback])
            for path, node in reached.items():
                self.branches[level[path[:-1]]][path[-1]] = node
            level = reached

    def step(self, node: int, letter: str) -> int:
        while letter not in self.branches[node]:
            if not node:
                return 0
            node = self.shorter[node]
        return self.branches[node][letter]


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves,
    the others in order from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(0x100 + n) for n, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


Coded = tuple[str, int, str]  # joined ids, how many, joined names


class Pieces:
    """What a worker knows so far: each word's and each piece's ids. Tokens
    decode to their names joined by spaces."""

    def __init__(self, path: str):
        self.model = TrieEncoder(path)
        self.words: dict[str | int, Coded] = {}
        self.known: dict[str, Coded] = {}
        self.older: tuple[dict, dict] = ({}, {})

    def coded(self, found: list[str]) -> list[Coded]:
        if len(self.known) > KNOWN_PIECES // 2:  # what is not met again in the next half is forgotten
            self.older, self.words, self.known = (self.words, self.known), {}, {}
        old_words, old_pieces = self.older
        for piece in found:
            if piece not in self.known and piece in old_pieces:
                self.known[piece] = old_pieces[piece]
        new = [p for p in found if p not in self.known]
        if new:
            model, words = self.model, self.words
            parts = [model.words(p) for p in new]
            words.update({w: old_words[w] for p in parts for w in p if w not in words and w in old_words})
            fresh = {w for p in parts for w in p if w not in words}
            for word, ids in model.encode_words(w for w in fresh if isinstance(w, str)).items():
                words[word] = " ".join(map(str, ids)), len(ids), " ".join([model.names[i] for i in ids])
            for special in (w for w in fresh if isinstance(w, int)):
                words[special] = str(special), 1, model.names[special]
            for piece, part in zip(new, parts, strict=True):
                if len(part) == 1:
                    self.known[piece] = words[part[0]]
                else:
                    got = [words[w] for w in part]
                    self.known[piece] = " ".join([g[0] for g in got]), sum([g[1] for g in got]), " ".join([g[2] for g in got])
        return [self.known[p] for p in found]


def encode_texts(
    df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True
) -> DataFrame:
    """(id, n_tokens, ids, decoded): the ids of each whole text as decimals joined
    by one space, and the text they decode to.

    `tokenizer` is the path of a tokenizer file on every executor. Null and
    empty texts have no ids; repeated rows each give a row; other columns are
    ignored. With `keep_ids` off, (id, n_tokens, ids_sha256, decoded_sha256).
    """
    kind = df.schema[id_col].dataType
    text = [T.StructField("ids", T.StringType()), T.StructField("decoded", T.StringType())]
    hashed = [T.StructField(n, T.StringType()) for n in ("ids_sha256", "decoded_sha256")]
    schema = T.StructType(
        [T.StructField("id", kind), T.StructField("n_tokens", T.LongType()), *(text if keep_ids else hashed)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.freeze()  # the tables hold no cycles; without this each collection walks them all
        worker = kept(("trie", tokenizer), lambda: Pieces(tokenizer))
        for whole in batches:
            for batch in slices(whole, "text"):
                found, codes, begins = pieces(strings(batch.column("text")))
                coded = worker.coded(found)
                ids = pa.array([c[0] for c in coded], pa.large_string())
                names = pa.array([c[2] for c in coded], pa.large_string())
                count = np.array([c[1] for c in coded], np.int64)[codes]
                # Pieces without ids take no part in the joined lists.
                full = count > 0
                places = np.concatenate([[0], np.cumsum(full)])[begins]
                used = pa.array(codes[full])
                joined = []
                for values in (ids, names):
                    lists = pa.ListArray.from_arrays(pa.array(places, pa.int32()), values.take(used))
                    joined.append(pc.binary_join(lists, pa.scalar(" ", pa.large_string())))
                if not keep_ids:
                    joined = [
                        pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in j]) for j in joined
                    ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(sums(count, begins)), *[pc.cast(j, pa.string()) for j in joined]],
                    names=schema.names,
                )

    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, schema)
