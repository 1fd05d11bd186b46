"""Every operator on rows that are odd in some way, next to plain Python."""

from __future__ import annotations

import random
from collections import Counter

import plain
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinfold.llm import bpe_trie, byte_tokens, edit_counts, fingerprint, hamming, html_text, language, licenses
from kinfold.llm import packing, radix, suffix
from kinfold.llm.vocabularies import tokenizer


def got(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


# --- fingerprints ---


def test_fingerprints_follow_edits_and_order(messy, raw):
    ordered = sorted(raw, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = Counter()
    for (i, text), (_, after) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, other, following = (fingerprint.fingerprints([t.encode()])[0][0] for t in (text, edited, after))
        near = fingerprint.containment(own, other), fingerprint.containment(own, following)
        want[(i, len(text), plain.sha(edited), fingerprint.written(own), fingerprint.written(other), *near)] += 1
    found = fingerprint.compare_edited(messy)
    assert got(found, *found.columns) == want


def test_chunks_join_to_the_text_and_survive_a_shift():
    text = random.Random(5).randbytes(40_000)
    begins = [0, len(text)]
    ends = fingerprint.chunk_ends(__import__("numpy").frombuffer(text, "uint8"), begins)[0]
    sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert sum(sizes) == len(text) and max(sizes) <= fingerprint.MOST
    assert all(n >= fingerprint.LEAST - 3 for n in sizes[:-1])
    own, moved = (x[0] for x in fingerprint.fingerprints([text, b"a few bytes more" + text]))
    assert fingerprint.containment(own, moved) > 0.98


def test_block_borders_do_not_move_cuts(monkeypatch):
    text = random.Random(6).randbytes(9_000)
    whole = fingerprint.fingerprints([text])
    monkeypatch.setattr(fingerprint, "BLOCK_BYTES", 100)
    assert fingerprint.fingerprints([text]) == whole


# --- exact duplicates ---


def test_exact_groups_are_those_of_the_normalised_texts(messy, raw):
    found = radix.exact_groups(messy, carry=["lang", "id"])
    assert got(found, "id", "keep_id", "group_size", "text_sha256") == Counter(plain.exact_groups(raw))
    kept = Counter(r.text_sha256 for r in found.filter("kept").collect())
    assert set(kept.values()) == {1} and len(kept) == len({r[3] for r in plain.exact_groups(raw)})
    assert found.filter("kept AND doc.id != 'x'").count() == 0


def test_texts_that_part_late_are_told_apart(spark):
    long = "abc " * 30_000
    docs = [(1, long + "x"), (2, long + "y"), (3, long + "x"), (4, long)]
    found = radix.exact_groups(spark.createDataFrame(docs, "doc_id long, text string"))
    assert got(found, "id", "keep_id", "group_size", "text_sha256") == Counter(plain.exact_groups(docs))


# --- main text ---

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div class="cookie-notice">We use cookies, many of them, on every page you read here.</div>
<script>var a = "</p><p>not text";</script><!-- <p>hidden</p> -->
<article><h1>Title &amp; more</h1><p><b>First   one.<br><p>Second &lt;b&gt; &#233;&eacute;
line</p><div class=ad>Buy this now!</div><section><p>Third part is here as well, long enough.</p>
<ul><li>item one<li>item two</ul></section>
<section id="comments"><p>A reader writes a rather long comment about all of this, as they do.</p></section></article>
<aside><p>Other stories that we think you may like to read one day.</p></aside>
<form><label>Mail</label><input><button>Subscribe</button></form><footer>&copy; us</footer></body></html>"""


def test_article_without_the_rest(spark):
    docs = [(1, PAGE), (2, None), (3, ""), (4, "plain words < 3 &am"), (4, PAGE[:700]), (5, "<p>open <b>all")]
    pages = spark.createDataFrame([(*d, "x") for d in docs], "page_id long, html string, id string")
    found = {}
    for i, text in html_text.extract(pages).collect():
        found.setdefault(i, []).append(text)
    whole = "Title & more\nFirst one.\nSecond <b> éé line\nThird part is here as well, long enough.\nitem one\nitem two"
    assert found[1] == [whole]
    assert found[2] == found[3] == [""]
    assert found[5] == ["open all"]
    assert "plain words < 3 &am" in found[4] and len(found[4]) == 2


@pytest.mark.parametrize("page", ["<", "<a", "<!--", "</p></div>", "<script>", "<p" * 50, "<div class='a" + "b" * 20, "&#x110000;<p>&#0;"])
def test_broken_pages_do_no_harm(page):
    assert isinstance(html_text.main_text(page), str)


def test_wrapped_article_is_found():
    text = "A paragraph with a fair number of words in it, as articles have them. " * 3
    body = "".join(f"<p>{text}{n}</p>" for n in range(6))
    links = "".join(f"<li><a href=/{n}>Link number {n}</a></li>" for n in range(20))
    page = f"<body><div id=wrap><div><ul>{links}</ul></div><div><div>{body}</div></div></div></body>"
    assert html_text.main_text(page).count("\n") == 5 and "Link" not in html_text.main_text(page)


# --- repeated passages ---


def test_repeated_spans_are_those_of_all_windows(messy, raw):
    found = suffix.repeated_spans(messy).select(
        "id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("gone"), F.size("spans"), F.sha2("kept", 256)
    )
    assert got(found, *found.columns) == Counter(plain.repeated(raw))


def test_large_keys_are_split_without_loss(spark, monkeypatch):
    pick = random.Random(7)
    passage = "".join(pick.choice("abcdefgh ") for _ in range(260))
    docs = []
    for i in range(60):
        text = f"{i} " * 30 + passage[: 180 + i] + f" {i}" * pick.randint(1, 40)
        docs.append((i, text))
    monkeypatch.setattr(suffix, "KEY_BYTES", 1500)
    found = suffix.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).select(
        "id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("gone"), F.size("spans"), F.sha2("kept", 256)
    )
    assert got(found, *found.columns) == Counter(plain.repeated(docs))


def test_interval_expansion_against_all_pairs():
    pick = random.Random(1)
    for _ in range(200):
        length, letters = pick.choice([1, 2, 3, 5, 8]), pick.choice([1, 2, 3, 200])
        texts = [bytes(pick.randrange(letters) for _ in range(pick.randrange(30))) for _ in range(pick.randrange(6))]
        seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        want, begin = [], 0
        for t in texts:
            want += [begin + i for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1]
            begin += len(t) + 1
        assert suffix.repeated_starts(texts, length).tolist() == want


def test_cut_characters_go_as_a_whole(spark):
    text = "é" * 150
    docs = spark.createDataFrame([(1, "x" + text), (2, text + "y")], "doc_id long, text string")
    kept = {r.id: r.kept for r in suffix.repeated_spans(docs, as_text=True).collect()}
    assert kept == {1: "x", 2: "y"}


# --- packing ---


def test_pieces_hold_every_token_once(messy, raw):
    packed = packing.piece_columns(packing.pack(messy, tokenizer("byte_bpe_50k.json"), window=4096))
    plain.pieces_fit(raw, [tuple(r) for r in packed.collect()])


def test_windows_hold_the_target_shares(spark):
    docs = [(i, f"word {i} " * 100, "ab"[i % 2]) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    shares, window = {"a": 0.75, "b": 0.25}, 4096
    packed = packing.pack(df, tokenizer("byte_bpe_50k.json"), window=window, shares=shares)
    used = {(r.window, r.queue): r.n for r in packed.groupBy("window", "queue").agg(F.sum("length").alias("n")).collect()}
    full = [w for w, q in used if q == "a"][:-1]
    assert len(full) > 5
    for w in sorted({w for w, _ in used})[:5]:
        assert abs(used[w, "a"] - 3072) <= 1 and abs(used[w, "b"] - 1024) <= 1
    plain.pieces_fit([d[:2] for d in docs], [tuple(r) for r in packing.piece_columns(packed).collect()])


def test_dry_queues_hand_on_their_share():
    plan = packing.Schedule(["a", "b", "c"], [1000, 10, 0], 100, {"a": 0.5, "b": 0.5})
    assert plan.served(plan.windows) == [1000, 10, 0]
    cuts = [c for q, n in ((0, 1000), (1, 10)) for c in plan.cut(q, 0, n, 64)]
    places = sorted(p for _, n, s, o, _ in cuts for p in range(s * 64 + o, s * 64 + o + n))
    assert places == list(range(1010))


# --- licenses ---


def test_notice_found_by_its_words(spark):
    texts = [
        (1, "Some text.\nReleased under the MIT license.\nmore"),
        (2, "released to the public under the new MIT kind of License"),
        (3, licenses.NOTICES["MIT-text"].replace("whom", "who").replace("merge, ", "")),
        (4, "nothing of the kind"),
        (5, None),
        (5, ""),
    ]
    df = spark.createDataFrame([(*t, 1.0) for t in texts], "doc_id long, text string, coverage double")
    found = {r.id: r for r in licenses.scan(df).collect()}
    assert (found[1].license, found[1].coverage, found[1].first_word, found[1].n_words) == ("MIT", 1.0, 2, 5)
    assert found[3].license == "MIT-text" and 0.95 < found[3].coverage < 1
    assert found[4].license is None and found[5].license is None
    want = {i: licenses.best_match(t or "", {n: licenses.words(x) for n, x in licenses.NOTICES.items()}) for i, t in texts}
    assert {i: (r.license if r.license else None) for i, r in found.items()} == {i: w and w[0] for i, w in want.items()}


def test_longest_increasing_run():
    pairs = [(3, 0), (1, 1), (4, 2), (2, 3), (5, 4)]
    chain = licenses.longest_increasing(pairs)
    assert len(chain) == 3 and [c[0] for c in chain] == sorted(c[0] for c in chain)
    assert licenses.longest_increasing([]) == []


def test_alignment_keeps_order_and_equal_words():
    pick = random.Random(3)
    for _ in range(100):
        a, b = ([pick.choice("abcdefghij") for _ in range(pick.randrange(15))] for _ in range(2))
        pairs = licenses.aligned(a, b)
        assert all(a[x] == b[y] for x, y in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


# --- counts after edits ---


def test_counts_after_edits_are_those_of_the_edited_text(messy):
    coder = plain.tokenizer("byte_bpe_50k.json")
    coder.encode_special_tokens = True
    found = edit_counts.count_edited(messy, edit_counts.sample_edits(messy["text"]), tokenizer("byte_bpe_50k.json"))
    both = found.collect()
    assert len(both) == messy.count()
    texts = Counter((r.doc_id, len(coder.encode(r.text or "", add_special_tokens=False).ids)) for r in messy.collect())
    assert Counter((r.id, r.n_tokens) for r in both) == texts
    for r in both:
        assert r.n_edited == len(coder.encode(r.edited, add_special_tokens=False).ids)
        assert r.n_encoded < 150


def test_random_edits_keep_the_tree_right():
    counts = edit_counts.Counts(tokenizer("byte_bpe_50k.json"))
    pick = random.Random(3)
    parts = ["a", " ", "  ", "\n", "'", "'s", "the word", " x1 ", "é", "!!", "\t \n"]
    for _ in range(300):
        text = "".join(pick.choice(parts) for _ in range(pick.randrange(200)))
        chars, tokens, begins = counts.leaves(pa.array([text, "rest"], pa.large_string()))
        tree = edit_counts.CountTree(chars[: begins[1]], tokens[: begins[1]])
        for _ in range(4):
            at = pick.randrange(len(text) + 1)
            gone = min(len(text) - at, pick.choice([0, 0, 1, 5, 400]))
            edit = at, gone, "".join(pick.choice(parts) for _ in range(pick.randrange(4)))
            new = edit_counts.apply(text, edit)
            tree.edit(text, new, edit, counts)
            text = new
            assert tree.total == sum(counts.split_one(text)[1])


# --- near duplicates ---


def test_near_classes_are_those_of_all_pairs(messy, raw):
    found = hamming.near_classes(messy)
    assert got(found, "id", "n_shingles", "component_id") == Counter(plain.near_classes(raw))
    assert found.filter("kept != (id <=> component_id)").count() == 0


def test_chains_and_borders_of_similarity(spark):
    words = plain_words = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(12):  # neighbours are similar, the ends are not
        docs.append((100 - i, " ".join(plain_words[i * 8 : i * 8 + 120])))
    for i in range(40):  # copies with one word changed somewhere
        changed = [*words[200:]]
        changed[i * 4] = f"x{i}"
        docs.append((200 + i, " ".join(changed)))
    found = hamming.near_classes(spark.createDataFrame(docs, "doc_id long, text string"))
    assert got(found, "id", "n_shingles", "component_id") == Counter(plain.near_classes(docs))


def test_blocks_of_a_key_meet_in_cells(spark, monkeypatch):
    """Texts that share half their words are no duplicates, but meet under many keys."""
    words, docs = [f"w{i}" for i in range(120)], []
    for i in range(60):
        docs.append((i, " ".join([*words, *[f"d{i // 3}x{j}" for j in range(40)], f"e{i}"])))
    monkeypatch.setattr(hamming, "BLOCK", 4)
    found = hamming.near_classes(spark.createDataFrame(docs, "doc_id long, text string"))
    assert got(found, "id", "n_shingles", "component_id") == Counter(plain.near_classes(docs))


def test_every_pair_within_the_distance_shares_a_key():
    import numpy as np

    pick = np.random.default_rng(1)
    for _ in range(300):
        a = pick.integers(0, 256, hamming.VALUES)
        b = a.copy()
        at = pick.choice(hamming.VALUES, hamming.DISTANCE, replace=False)
        b[at] = pick.integers(0, 256, hamming.DISTANCE)
        differ = (a != b).reshape(hamming.CHUNKS, hamming.PER_CHUNK)
        assert differ.sum(axis=1).min() <= 1
        chunk, out = divmod(hamming.first_key(a != b), hamming.PER_CHUNK)
        assert differ[chunk].sum() == differ[chunk, out]
        assert all(differ[c].sum() > 1 for c in range(chunk))


# --- language ---


def test_language_learned_from_words_and_grams(spark, messy, empty):
    model = language.train(messy)
    assert model.languages == ["en", "fr"]
    found = language.identify(messy, model)
    by_id = {}
    for r in found.collect():
        by_id.setdefault(r.id, []).append((r.lang_pred, r.score))
    assert all(by_id[i] == [("und", 0.0)] for i in (18, 19, 20, 21))
    assert by_id[24][0][0] == "en" and len(by_id[27]) == 3
    assert all(0 <= s <= 1 for v in by_id.values() for _, s in v)
    nothing = language.identify(messy, language.train(empty))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_held_out_languages_are_told_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs.filter("doc_id % 2 = 0"))
    tested = language.identify(docs.filter("doc_id % 2 = 1"), model).join(docs, F.col("id") == F.col("doc_id"))
    right, n = tested.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count(F.lit(1))).first()
    assert n == 500 and right > 0.99


# --- encoding ---


def test_ids_and_text_are_those_of_the_library(messy, raw):
    coder = plain.tokenizer("word_bpe_49k.json")
    want = Counter()
    for i, text in raw:
        ids = coder.encode(text or "", add_special_tokens=False).ids
        want[(i, len(ids), " ".join(map(str, ids)), coder.decode(ids, skip_special_tokens=False))] += 1
    found = bpe_trie.encode_texts(messy, tokenizer("word_bpe_49k.json"))
    assert got(found, "id", "n_tokens", "ids", "decoded") == want
    short = bpe_trie.encode_texts(messy, tokenizer("word_bpe_49k.json"), keep_ids=False)
    assert got(short, "id", "n_tokens", "ids_sha256", "decoded_sha256") == Counter(
        {(i, n, plain.sha(a), plain.sha(b)): c for (i, n, a, b), c in want.items()}
    )


def test_trie_words_in_any_letters():
    coder = plain.tokenizer("word_bpe_49k.json")
    texts = ["don't I'LL it's", "ΑΣ ΑΣ. İstanbul", "\x1c a\x1fb \x85 ½ ٣ 12 日本語", "<|startoftext|>A<|ENDOFTEXT|>", "x" * 300]
    known = bpe_trie.Pieces(tokenizer("word_bpe_49k.json"))
    for text in texts:
        ids = [int(i) for c in known.coded(text.split(" ")) if c[1] for i in c[0].split(" ")]
        assert ids == coder.encode(text, add_special_tokens=False).ids
    assert known.model.encode_words(["", "a"])[""] == []


def test_byte_ids_of_cut_texts(raw):
    coder = plain.tokenizer("byte_bpe_50k.json")
    texts = [t or "" for _, t in raw] + ["a   b", " x \n \n y ", "  　 z", "", " "]
    ids, begins = byte_tokens.ByteTokens(tokenizer("byte_bpe_50k.json")).ids(pa.array(texts, pa.large_string()))
    for a, b, text in zip(begins, begins[1:], texts, strict=False):
        assert ids[a:b].tolist() == coder.encode(text, add_special_tokens=False).ids


# --- empty tables ---


def test_empty_tables_give_no_rows(empty):
    model = language.train(empty)
    byte, word = tokenizer("byte_bpe_50k.json"), tokenizer("word_bpe_49k.json")
    pages = empty.selectExpr("doc_id AS page_id", "text AS html")
    for df in (
        fingerprint.compare_edited(empty),
        radix.exact_groups(empty),
        html_text.extract(pages),
        suffix.repeated_spans(empty),
        packing.pack(empty, byte),
        licenses.scan(empty),
        edit_counts.count_edited(empty, edit_counts.sample_edits(empty["text"]), byte),
        hamming.near_classes(empty),
        language.identify(empty, model),
        bpe_trie.encode_texts(empty, word),
    ):
        assert df.count() == 0
