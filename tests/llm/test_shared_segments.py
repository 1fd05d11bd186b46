"""Passages that a great many texts share beside texts that differ."""

from __future__ import annotations

import random

from kinfold.llm import suffix


def test_rows_of_a_frequent_passage_are_not_joined_with_it(spark):
    pick = random.Random(6)

    def words(n):
        return " ".join(str(pick.randrange(10**8)) for _ in range(n))

    passage, line = words(40), words(22)
    texts = [f"{words(40)} {passage} {words(40)}" for _ in range(30)]
    texts += [passage] * 10 + [line + " end", line + " fin", words(60), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = suffix.segment_rows(docs.selectExpr("doc_id AS id", "xxhash64(text) AS h", "coalesce(text, '') AS text"))
    whole, _ = suffix.shared_segments(rows)
    assert "Join" not in whole._jdf.queryExecution().optimizedPlan().toString()
    got = {r.id: (r.n_removed, r.n_spans) for r in suffix.digest_columns(suffix.repeated_spans(docs)).collect()}
    starts: dict[str, int] = {}
    for t in texts:
        for at in range(len(t or "") - 199):
            starts[t[at : at + 200]] = starts.get(t[at : at + 200], 0) + 1
    for i, t in enumerate(texts):
        hit = bytearray(len(t or ""))
        for at in range(len(hit) - 199):
            if starts[t[at : at + 200]] > 1:
                hit[at : at + 200] = b"\1" * 200
        assert got[i] == (sum(hit), len([x for x in bytes(hit).split(b"\0") if x]))


def test_segments_of_a_text_are_taken_from_each_other_as_numbers(spark):
    many = 3000
    met = [(1, 5, 200 * k, 7, suffix.MET) for k in range(many)]
    once = [(1, 5, 200 * k, 7, suffix.ONCE) for k in range(many) if k % 3]
    met += [(2, 6, 0, 9, suffix.MET), (2, 6, (1 << 31) - 300, 90, suffix.MET), (3, 7, 4, 1, suffix.MET)]
    once += [(2, 6, 0, 9, suffix.ONCE), (3, 7, 4, 1, suffix.ONCE)]
    found = spark.createDataFrame([*met, *once, (2, 6, 3, 4, suffix.WINDOWS)], "id long, h long, start long, n long, kind int")
    spans = suffix.spans_by_text(found)
    # Spark compares each struct with each, numbers it hashes.
    assert dict(spans.dtypes)["found"] == "array<bigint>"
    got = {r.of_id: [(x >> suffix.COUNT_BITS, x & suffix.COUNT_MASK) for x in r.found] for r in spans.collect()}
    assert got == {1: [(200 * k, 7) for k in range(0, many, 3)], 2: [(3, 4), ((1 << 31) - 300, 90)], 3: []}
