"""Sanitisation, prefix trie and hard negatives next to plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import disclosure, hard_negatives, prefix_trie


def got(df, *columns):
    return Counter(tuple(r) for r in df.select(*(columns or df.columns)).collect())


# --- personal data ---

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
PLAIN_WORD = re.compile(r"[^\W_]+")


def checks(kind, value):
    found = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(reversed(found)))
        return 16 <= len(found) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(found) <= 15


def base(text):
    hits = ((kind, m) for kind, pattern in PLAIN.items() for m in pattern.finditer(text or ""))
    return [(kind, m.start(), m.end(), m[0]) for kind, m in hits if checks(kind, m[0])]


def as_text(spans):
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def odd_texts():
    pick = random.Random(3)
    fixed = [
        *["a@b.c@d.e", "x@y.z%k@m.n..", "éabc@x.yé", ".a.@-.-.- a@b.c-.d", "\U0001f600 a@b.co \U0001f600 +44 20 7946 0958."],
        *["1.2.3.4.5.6.7.8", "001.002.0003.255 256.1.1.1", "+1 (555) 123-4567 4111 1111 1111 1111-", "", None],
        *["4111-1111-1111-1111 5 +12345678-", "12 34 56 78 90 12 34 56 78 90 12 34 56", "a" * 500 + "@b", "x\n a@b.c\n"],
        "a@b.c " * 300,
    ]
    fixed += ["".join(pick.choice("ab1.@+- %é4") for _ in range(60)) for _ in range(800)]
    return fixed + ["".join(pick.choice("14 -.+(") for _ in range(50)) for _ in range(800)]


def test_base_spans_are_those_of_the_plain_patterns(spark):
    texts = odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    found = disclosure.digest_columns(disclosure.personal_data(df, support=10**6))
    for r in found.collect():
        want = base(texts[r.id])
        assert r.spans == as_text(want), texts[r.id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in PLAIN]
        assert r.base_sha256 == hashlib.sha256(as_text(want).encode()).hexdigest()


def test_hostile_texts_take_no_square_of_their_length(spark):
    texts = ["a@b" + ".c" * 100_000, "1" * 100_000, "aa" * 100_000, "+1" + "(" * 50_000, "1." * 50_000, "a@" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.id: r.spans for r in disclosure.digest_columns(disclosure.personal_data(df)).collect()}
    assert found[0] == "email:0:200003" and found[1] == found[2] == found[3] == found[5] == ""
    assert found[4].startswith("ip:0:7,ip:8:15,")


def told(docs, generalise, support):
    """The flagged terms and their disclosure, by definition, from (id, text)."""
    near, holds, words = defaultdict(set), defaultdict(set), defaultdict(set)
    for row, (_, text) in enumerate(docs):
        for w in set(PLAIN_WORD.findall((text or "").lower())):
            words[w].add(row)
        for kind, start, end, value in base(text):
            e = f"{kind}:{value.lower()}"
            holds[e].add(row)
            same = [m for m in PLAIN[kind].finditer(text)]
            at = [m.start() for m in same].index(start)
            before = text[same[at - 1].end() if at else 0 : start]
            after = text[end : same[at + 1].start() if at + 1 < len(same) else len(text)]
            for part, last in ((before, True), (after, False)):
                for pattern in PLAIN.values():
                    part = pattern.sub(lambda m: " " if len(m[0]) > 5 else m[0], part)
                some = PLAIN_WORD.findall(part.lower())
                for w in some[-5:] if last else some[:5]:
                    if len(w) >= 3 and re.search(r"[^\W\d_]", w):
                        near[e, w].add(row)
    best = {}
    for (e, w), rows in near.items():
        if len({docs[r][1] for r in rows}) >= support and len(holds[e]) < len(docs):
            n = len(docs)
            share = math.log2(n * len(rows) / (len(words[w]) * len(holds[e]))) / math.log2(n / len(holds[e]))
            if share >= generalise:
                best[w] = max(best.get(w, 0), share)
    return best


def private_docs():
    pick = random.Random(8)
    some = "the of and river stone light water under over green quick seven".split()
    docs = []
    for i in range(120):
        body = [pick.choice(some) for _ in range(pick.randint(3, 40))]
        if i % 10 == 0:
            body[1:1] = ["Quillfeather", "wrote", f"q.feather@mail{i % 2}.example.com", "again"]
        if i % 15 == 0:
            body[0:0] = ["Ostrava", "+44 20 7946 0958", "desk"]
        if i == 33:
            body += ["quillfeather", "Éa"]
        docs.append((i, " ".join(body)))
    docs += [(200 + k, "Brontide sent b@c.de here") for k in range(6)]  # copies are one text
    return [*docs, (None, None), (300, ""), (300, ""), (301, "Quillfeather " * 50)]


def test_terms_are_those_of_the_definition_and_marked_everywhere(spark):
    docs = private_docs()
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, row long, base string")
    staged = disclosure.base_spans(df)
    want = told(docs, disclosure.GENERALISE, disclosure.SUPPORT)
    flagged = {r.term: (r.disclosure, r.removed) for r in disclosure.disclosing_terms(staged).collect()}
    assert flagged.keys() == want.keys() and {"quillfeather", "ostrava"} <= want.keys() and "brontide" not in want
    for w, (share, removed) in flagged.items():
        assert abs(share - want[w]) < 1e-9 and removed == (share >= disclosure.REMOVE)
    found = disclosure.personal_data(df).withColumn("written", disclosure.written(F.col("spans")))
    result, expected = Counter(), Counter()
    for r in found.collect():
        result[r.id, r.written] += 1
        if r.id == 301:
            assert "Quillfeather" not in r.sanitised
        if r.id == 0:
            assert "[EMAIL]" in r.sanitised and "[PHONE]" in r.sanitised and "example" not in r.sanitised
    for i, text in docs:
        spans = base(text)
        terms = [("term", m.start(), m.end()) for m in PLAIN_WORD.finditer(text or "") if m[0].lower() in want]
        terms = [t for t in terms if not any(b[1] < t[2] and t[1] < b[2] for b in spans)]
        expected[i, as_text([*spans, *terms])] += 1
    assert result == expected


def test_personal_data_of_no_rows_and_no_python_in_the_plan(spark, empty):
    found = disclosure.digest_columns(disclosure.personal_data(empty))
    assert found.count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- prefix trie ---


def plain_trie(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            said = (r or "", x or "")
            code = hashlib.sha256(f"{len(said[0].encode())}:{said[0]}{said[1]}".encode()).digest()
            turns[c].append((t is not None, t or 0, code, said))
    own = {c: [x[3] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = Counter()
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        parent = min(members[p[:-1]]) if p else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out[min(m), len(p), parent, len(m), children[p], leaves[p], saved[p], digest] += 1
    return out


def trie_rows(seed, convs=60, longest=14, texts=2):
    pick = random.Random(seed)
    rows = []
    for c in range(0, convs):
        if pick.random() < 0.15:
            continue
        for t in range(pick.randint(1, longest)):
            role = pick.choice(["user", None]) if t % 2 == 0 else "assistant"
            text = pick.choice([None, "", "same é"]) if t < 9 else f"t{pick.randint(0, texts)}"
            rows.append((c, t if pick.random() < 0.9 else None, role, text))
    rows += [(2**40, 0, "user", "x"), (2**40, 0, "user", "x"), (None, 1, "user", "lost"), (7, 3, None, None)]
    return rows


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("seed", "shard"), [(1, 4096), (2, 7), (3, 1)])
def test_trie_is_that_of_plain_python(spark, monkeypatch, seed, shard):
    """Also with so few conversations a shard that every node meets in several."""
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    rows = trie_rows(seed)
    df = spark.createDataFrame([(*r, 1, b"y", "z") for r in rows], f"{TURNS}, pos long, path binary, code string")
    found = prefix_trie.digest_columns(prefix_trie.prefix_trie(prefix_trie.rebuilt(df.repartition(5))))
    assert got(found) == plain_trie(rows)


def test_trie_of_copies_and_a_long_conversation(spark):
    copies = [(5 * c, t, "user", f"turn {t}") for c in range(300) for t in range(9)]
    long = [(3, t, "user", f"line {t % 50}") for t in range(20_000)]
    df = spark.createDataFrame(copies + long, TURNS).repartition(6)
    assert got(prefix_trie.digest_columns(prefix_trie.prefix_trie(prefix_trie.rebuilt(df)))) == plain_trie_long(copies + long)


def plain_trie_long(rows):
    """As `plain_trie`, for rows of which one conversation is long and alone below its head."""
    head = [r for r in rows if r[0] != 3 or r[1] < 30]
    short = plain_trie(head)
    n_long = sum(r[0] == 3 for r in rows)
    last = [r for r in short if r[0] == 3 and r[3] == 1]
    deepest = max(r[1] for r in last)
    out = Counter({r: n for r, n in short.items() if not (r[0] == 3 and r[1] == deepest)})
    none = hashlib.sha256(b"").hexdigest()
    full = deepest + n_long - 30
    parent = next(r[2] for r in last if r[1] == deepest)
    for depth in range(deepest, full + 1):
        up = parent if depth == deepest else 3
        digest = hashlib.sha256(b"3").hexdigest() if depth == full else none
        out[3, depth, up, 1, int(depth < full), 1, 0, digest] += 1
    return out


def test_trie_of_numbered_turns_and_of_no_rows(spark):
    df = spark.createDataFrame([(1, 0, "u", "a"), (2, 0, "u", "a"), (2, 1, "u", "b")], TURNS)
    found = prefix_trie.digest_columns(prefix_trie.prefix_trie(prefix_trie.numbered(df)))
    nodes = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in found.collect()}
    assert nodes == {(1, 0): (None, 2, 1, 1, 1), (1, 1): (1, 2, 1, 1, 1), (2, 2): (1, 1, 0, 1, 0)}
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(df.filter("false"))).nodes.count() == 0


# --- hard negatives ---

VECTORS = "vec_id long, embedding array<double>, label int"


def plain_negatives(rows):
    kept = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, label, [math.floor(256 * x) for x in v]))
    out = Counter()
    for a, (i, label, v) in enumerate(kept):
        if i is None or i % 100:
            continue
        score = [sum(p * q for p, q in zip(v, w, strict=False)) for _, _, w in kept]
        order = sorted(range(len(kept)), key=lambda k: (-score[k], kept[k][0] is None, kept[k][0] or 0))
        for p in [k for k in order if k != a and kept[k][1] == label][:5]:
            window = [k for k in order if kept[k][1] != label and 80 * score[p] <= 100 * score[k] <= 100 * score[p]]
            for rank, k in enumerate(window[:5], 1):
                out[i, kept[p][0], rank, kept[k][0], score[p], score[k]] += 1
    return out


def vector_rows(seed, n=600, dims=6):
    pick = np.random.default_rng(seed)
    centres = pick.normal(size=(4, dims))
    rows = []
    for i in range(n):
        v = (centres[i % 4] + pick.normal(scale=0.4, size=dims)).tolist()
        rows.append((i * 25, v, int(pick.integers(0, 3))))
    hot = [0.5] * dims
    rows += [(100_000 + k, hot, k % 2) for k in range(150)]  # one vector, many times
    rows += [(200_000, None, 1), (200_100, [None] * dims, 1), (200_200, [float("nan")] * dims, 1), (200_300, hot, None)]
    rows += [(200_400, [float("inf")] * dims, 0), (None, hot, 0), (None, hot, 1), (300_000, [], 0), (300_100, [1.0], 0)]
    rows += [(300_200, [0.0] * dims, 1), (300, rows[12][1], 2), (300_300, [1e5] * dims, 0), (300_400, [1.0] * 9, 1)]
    return rows


@pytest.mark.parametrize(("cells", "group", "page"), [(1 << 16, 512, 512), (120, 3, 4)])
def test_hard_negatives_are_those_of_plain_python(spark, monkeypatch, cells, group, page):
    """Also in blocks, groups and pages of a few rows."""
    for name, value in (("CELLS", cells), ("GROUP", group), ("PAGE", page)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vector_rows(5)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], f"{VECTORS}, id long, size string").repartition(5)
    found = hard_negatives.hard_negatives(df, F.pmod("vec_id", F.lit(100)) == 0)
    want = plain_negatives(rows)
    assert got(found) == want and len(want) > 100


def test_hard_negatives_of_no_rows_and_no_anchors(spark):
    df = spark.createDataFrame([], VECTORS)
    assert hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0).count() == 0
    df = spark.createDataFrame([(1, [1.0], 0), (2, [1.0], 1)], VECTORS)
    assert hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0).count() == 0


def test_bounds_hold_for_all_vectors_of_a_box():
    pick = np.random.default_rng(1)
    vectors, anchors = pick.integers(-300, 300, (40, 8)), pick.integers(-300, 300, (20, 8))
    least, most = hard_negatives.bounds(anchors, vectors.min(0)[None], vectors.max(0)[None])
    scores = anchors @ vectors.T
    assert (least[:, 0] <= scores.min(1)).all() and (most[:, 0] >= scores.max(1)).all()


def test_hilbert_keys_walk_through_neighbours():
    side = np.arange(16)
    cells = np.stack(np.meshgrid(side, side), axis=-1).reshape(-1, 2)
    order = np.argsort([int.from_bytes(k, "big") for k in hard_negatives.hilbert_keys(cells, 4)])
    steps = np.abs(np.diff(cells[order], axis=0)).sum(1)
    assert (steps == 1).all()


def test_packed_numbers_come_back():
    for top in (1, 200, 40_000, 2**40):
        x = np.array([[-top, 0], [top, 5]])
        assert (hard_negatives.unpacked(hard_negatives.packed(x), 2, 2) == x).all()
