"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def tokenizer(name: str) -> Tokenizer:
    found = Tokenizer.from_file(public_tokenizers.path(name))
    found.no_truncation()
    found.no_padding()
    return found


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def exact_groups(docs: list[tuple]) -> list[tuple]:
    """(id, keep_id, group_size, text_sha256) of (id, text)."""
    bodies = [SPACES.sub(" ", t or "") for _, t in docs]
    groups = defaultdict(list)
    for (i, _), b in zip(docs, bodies, strict=True):
        groups[b].append(i)
    least = {b: min((x for x in ids if x is not None), default=None) for b, ids in groups.items()}
    return [(i, least[b], len(groups[b]), sha(b)) for (i, _), b in zip(docs, bodies, strict=True)]


def repeated(docs: list[tuple], length: int = 200) -> list[tuple]:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of (id, text)."""
    raw = [(t or "").encode() for _, t in docs]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(docs, raw, strict=True):
        gone = np.zeros(len(t), bool)
        for at in range(len(t) - length + 1):
            if seen[t[at : at + length]] > 1:
                gone[at : at + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((i, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), sha(kept)))
    return out


def shingles(text: str | None) -> frozenset:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in SPACES.split(lowered) if w]
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def near_classes(docs: list[tuple]) -> list[tuple]:
    """(id, n_shingles, component_id) of (id, text)."""
    sets = [shingles(t) for _, t in docs]
    component = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                old, new = component[a], component[b]
                component = [new if c == old else c for c in component]
    least: dict = {}
    for (i, _), c in zip(docs, component, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return [
        (i, len(s), least.get(c) if s else i) for (i, _), s, c in zip(docs, sets, component, strict=True)
    ]


def pieces_fit(docs: list[tuple], pieces: list[tuple], length: int = 2048) -> None:
    """Assert that (id, start, length, ids_crc32, doc_tokens, sequence_id, offset) rows
    hold every token once and fill the sequences without gaps."""
    coder = tokenizer("byte_bpe_50k.json")
    wanted, got = Counter(), Counter()
    for i, text in docs:
        wanted[(i, tuple([*coder.encode(text or "", add_special_tokens=False).ids, 1]))] += 1
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for i, start, n, crc, total, sequence, offset in pieces:
        by_doc[i, total].append((start, n, crc))
        by_sequence[sequence].append((offset, n))
    for (i, ids), copies in wanted.items():
        mine = by_doc[i, len(ids)]
        assert sum(n for _, n, _ in mine) == len(ids) * sum(
            c for (j, other), c in wanted.items() if j == i and len(other) == len(ids)
        )
        cuts = [(s, n) for s, n, c in mine if zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) == c]
        covered = Counter(p for s, n in cuts for p in range(s, s + n))
        assert all(covered[p] >= copies for p in range(len(ids)))
        got[i] += copies
    assert sum(got.values()) == len(docs)
    for sequence, parts in by_sequence.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at == length or (sequence == max(by_sequence) and at < length)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
