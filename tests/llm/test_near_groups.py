"""Large groups of texts that share most of their shingles and yet stay apart."""

from __future__ import annotations

import random

import numpy as np
import plain
import pytest

from kinfold.llm import hamming


def test_texts_of_one_origin_that_stay_apart_are_not_all_paired(spark, monkeypatch):
    pick = np.random.default_rng(3)
    base = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(60):
        words = list(base)
        for at in pick.choice(300, 5, replace=False):
            words[at] = f"own{i}x{at}"
        docs.append((i, " ".join(words)))
    docs += [(100 + i, docs[i][1] + " more") for i in range(5)]
    met = []
    whole = hamming.NearDuplicates.all_pairs
    monkeypatch.setattr(
        hamming.NearDuplicates, "all_pairs", lambda self, keys: (met.append(whole(self, keys)), met[-1])[1]
    )
    found = hamming.near_classes(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {r.id: r.component_id for r in found.collect()}
    sets = [set(zip(*[t.split()[k:] for k in range(5)], strict=False)) for _, t in docs]
    leader = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((leader[a], leader[b]))
                leader = [low if x == high else x for x in leader]
    assert got == {docs[i][0]: docs[x][0] for i, x in enumerate(leader)}
    assert met[0].count() <= 65  # hundreds before, with the square of the group


def test_cells_find_every_similar_pair(spark):
    pick = np.random.default_rng(8)
    shingles = []
    for _ in range(4):
        base = pick.integers(0, 1 << 63, int(pick.integers(1, 60)), np.uint64)
        for _ in range(30):
            kept = base[pick.random(len(base)) > pick.choice([0, 0.05, 0.1])]
            shingles.append(np.unique(np.append(kept, pick.integers(0, 1 << 63, int(pick.integers(0, 5)), np.uint64))))
    shingles = [s for s in shingles if len(s)]
    rows = [(i, i, s.tobytes()) for i, s in enumerate(shingles)]
    sets = spark.createDataFrame(rows, "node long, comp long, shingles binary").repartition(3)
    counts = hamming.shingle_counts(sets)
    assert counts.sum() == sum(map(len, shingles))
    parity = {r.node: bytes(r.parity) for r in hamming.parities(sets).collect()}
    sig = bytes(hamming.VALUES)
    for order in (counts, np.zeros_like(counts), counts.max() + 2 - counts):  # any order will do
        keys: dict[int, list] = {}
        for r in hamming.prefixes(sets, order, hamming.Bands()).collect():
            keys.setdefault(r.key, []).append((r.key, 0, 0, r.node, r.comp, r.n, r.at, r.leads, 0, sig, parity[r.node]))
        found = {(a, b) for cell in keys.values() for a, b, _ in hamming.cell_pairs(cell)}
        for b in range(len(shingles)):
            for a in range(b):
                both = len(np.intersect1d(shingles[a], shingles[b]))
                if 100 * both >= 85 * (len(shingles[a]) + len(shingles[b]) - both):
                    assert (a, b) in found


@pytest.mark.parametrize("few", [hamming.FEW_LINKS, 40, 0])
def test_components_of_chains_stars_and_rings_with_few_and_many_links(spark, monkeypatch, few):
    pick = random.Random(3)
    links = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 540)]
    links += [(700 + k, 700 + (k + 7) % 20) for k in range(20)] + [(pick.randrange(900, 990), pick.randrange(900, 990)) for _ in range(60)]
    pick.shuffle(links)
    nodes = sorted({x for pair in links for x in pair} | {1, 2})
    labels = spark.createDataFrame([(x, x) for x in nodes], "node long, comp long")
    monkeypatch.setattr(hamming, "FEW_LINKS", few)
    written = []
    keep = hamming.materialize
    monkeypatch.setattr(hamming, "materialize", lambda df, name: (written.append(name), keep(df, name))[1])
    got = {r.node: r.comp for r in hamming.components(labels, spark.createDataFrame(links, "a long, b long")).collect()}
    want = {x: x for x in nodes}
    for _ in nodes:
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want
    if few == hamming.FEW_LINKS and few > 1000:  # rounds of small jobs fill the driver's memory
        assert written == ["near-between", "near-labels"]


def chains() -> list[tuple]:
    """Neighbours of a chain are similar, its ends are not; ids and texts that are null,
    come twice or have no words; two texts that share a key with none."""
    words = [f"w{i}" for i in range(400)]
    docs = [(100 - i, " ".join(words[i * 8 : i * 8 + 120])) for i in range(12)]
    for i in range(40):
        changed = [*words[200:]]
        changed[i * 4] = f"x{i}"
        docs.append((200 + i, " ".join(changed)))
    docs += [(None, docs[0][1]), (None, docs[-1][1] + " more"), (200, docs[20][1]), (200, "alone"), (300, None), (300, ""), (301, " \n")]
    return [*docs, docs[3], (400, " ".join(f"y{i}" for i in range(50)))]


def test_texts_move_once_for_all_rounds(spark, monkeypatch):
    written = []
    keep = hamming.materialize
    monkeypatch.setattr(hamming, "materialize", lambda df, name: (written.append(name), keep(df, name))[1])
    found = hamming.near_classes(spark.createDataFrame(chains(), "doc_id long, text string"))
    got = sorted((str(r.id), r.n_shingles, str(r.component_id)) for r in found.collect())
    assert got == sorted((str(i), n, str(c)) for i, n, c in plain.near_classes(chains()))
    assert written.count("near-pairs") > 2 and written.count("near-full") == 1


def test_only_the_sets_of_the_pairs_move(spark):
    run = hamming.NearDuplicates(spark.createDataFrame(chains(), "doc_id long, text string"), "doc_id", "text")
    shingles = {k: np.arange(k, k + 100, dtype=np.uint64).tobytes() for k in range(0, 400, 4)}
    run.full = spark.createDataFrame([*shingles.items()], "node long, shingles binary")
    pairs = spark.createDataFrame([(0, 4), (0, 20), (0, 200), (40, 44), (40, 3)], "a long, b long")
    found = run.similar(pairs)
    assert sorted((r.a, r.b) for r in found.collect()) == [(0, 4), (40, 44)]
    assert "LeftSemi" in found._jdf.queryExecution().executedPlan().toString()


def test_no_pairs_at_all(spark):
    docs = [(1, None), (1, ""), (None, None), (2, "one two"), (3, "three")]
    found = hamming.near_classes(spark.createDataFrame(docs, "doc_id long, text string"))
    got = sorted((str(r.id), r.n_shingles, str(r.component_id), r.kept) for r in found.collect())
    assert got == [("1", 0, "1", True), ("1", 0, "1", True), ("2", 1, "2", True), ("3", 1, "3", True), ("None", 0, "None", True)]
