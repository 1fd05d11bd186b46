"""Ids of a byte-level BPE tokenizer for many texts, distinct pieces encoded once.

The tokenizer's pattern gives each word its one leading space, so a text may be
cut before every single space and the parts encoded on their own. That changes
the result only where a run of white space goes on across such a cut, or a
special token stands in the text; those texts are encoded whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bpe_trie import byte_letters
from .texts import kept, pieces, spans, sums

KNOWN_PIECES = 300_000  # pieces a worker remembers; results do not depend on it
LATIN = "\u0250"  # the first letter after the Latin ones
SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


# Fixed value: how the tokenizer's file splits a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def rank_encoder(path: str):
    """An encoder that merges by the order of ids, from the same file, if that is also
    the order of its merges; else none."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, splits = spec["model"], spec["pre_tokenizer"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in pairs]
    plain = splits["type"] == "ByteLevel" and splits["use_regex"] and not splits["add_prefix_space"]
    if not plain or spec["normalizer"] or made != sorted(made) or len(made) + 256 != len(model["vocab"]):
        return None
    byte = {letter: b for b, letter in enumerate(byte_letters())}
    ranks = {bytes(byte[c] for c in name): i for name, i in model["vocab"].items()}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class ByteTokens:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task its core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        escaped = ["".join(f"[{c}]" if c not in "^\\" else f"\\{c}" for c in s) for s in special]
        self.whole = "|".join([f"{SPACE} {SPACE}", *escaped])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.ranked = rank_encoder(path)

    def encode(self, texts: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(c.ids, "<u2").tobytes() for c in coded]

    def encode_pieces(self, found: list[str]) -> list[bytes]:
        """Pieces in Latin letters go through the rank encoder, which gives the same ids
        several times faster; the others, where Unicode tables could differ, do not."""
        latin = [i for i, p in enumerate(found) if self.ranked and (p.isascii() or max(p) < LATIN)]
        if len(latin) == len(found):
            return [np.array(self.ranked.encode_ordinary(p), "<u2").tobytes() for p in found]
        out: list[bytes] = [b""] * len(found)
        for i in latin:
            out[i] = np.array(self.ranked.encode_ordinary(found[i]), "<u2").tobytes()
        rest = sorted(set(range(len(found))).difference(latin))
        for i, ids in zip(rest, self.encode([found[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def coded(self, found: list[str]) -> list[bytes]:
        if len(self.known) > KNOWN_PIECES // 2:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new = []
        for piece in found:
            if piece not in known:
                if piece in older:
                    known[piece] = older[piece]
                else:
                    new.append(piece)
        known.update(zip(new, self.encode_pieces(new), strict=True))
        return [known[p] for p in found]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin (one more at the end)."""
        if not len(texts):
            return np.zeros(0, "<u2"), np.zeros(1, np.int64)
        slow = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        quick = texts if not slow.any() else texts.filter(pa.array(~slow))
        flat, lengths = self.quick(quick) if len(quick) else (np.zeros(0, "<u2"), np.zeros(0, np.int64))
        if not slow.any():
            return flat, np.concatenate([[0], np.cumsum(lengths)])
        rest = [np.frombuffer(x, "<u2") for x in self.encode(texts.filter(pa.array(slow)).to_pylist())]
        all_flat = np.concatenate([flat, *rest])
        all_lengths, begin = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
        all_lengths[~slow], all_lengths[slow] = lengths, [len(x) for x in rest]
        begin[~slow] = np.cumsum(lengths) - lengths
        begin[slow] = len(flat) + np.cumsum(all_lengths[slow]) - all_lengths[slow]
        return all_flat[spans(begin, all_lengths)], np.concatenate([[0], np.cumsum(all_lengths)])

    def quick(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found, codes, begins = pieces(texts)
        # The first piece of a text has no space before it.
        firsts, place = np.unique(codes[begins[:-1]], return_inverse=True)
        codes = codes.astype(np.int64)
        codes[begins[:-1]] = len(found) + place
        coded = self.coded([f" {p}" for p in found] + [found[c] for c in firsts])
        size = np.array([len(c) for c in coded], np.int64) // 2
        flat = np.frombuffer(b"".join(coded), "<u2")
        lengths = size[codes]
        return flat[spans((np.cumsum(size) - size)[codes], lengths)], sums(lengths, begins)


def byte_tokens(path: str) -> ByteTokens:
    """The worker's own tables for this tokenizer."""
    return kept(("ranks", path), lambda: ByteTokens(path))
