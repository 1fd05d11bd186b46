"""The history of a stream's hashes: merges, replays, merges that break off, files opened."""

from __future__ import annotations

import glob
import hashlib
import os

import pytest

from kinfold.streaming.hash_history import HashHistory, Run


def digest(i):
    return hashlib.md5(str(i).encode()).hexdigest()


def rows(spark, numbers):
    return spark.createDataFrame([(digest(i),) for i in numbers], "text_hash string")


def ids(df):
    return sorted(r.text_hash for r in df.collect())


def batch(n):
    return range(4 * n, 4 * n + 4)


def test_runs_cover_all_batches_and_stay_few(spark, tmp_path):
    history = HashHistory(spark, f"{tmp_path}/h", 3)
    assert history.cover(5) == [] and history.known(rows(spark, [1]), 0).count() == 0
    for n in range(28):
        history.tidy(n)
        history.add(rows(spark, batch(n)), n)
        runs = history.cover(n + 1)
        covered = [b for r in runs for b in range(r.first, r.last + 1)]
        assert covered == list(range(n + 1))
        digits = sum(int(d) for d in _base3(n + 1))
        assert len(runs) == digits
    assert history.cover(28) == [Run(0, 26, history.cover(28)[0].path, True), history.cover(28)[1]]
    assert ids(history.hashes(history.cover(28))) == sorted(map(digest, range(28 * 4)))
    # Files of a shard: at most one run of each level, each sorted.
    history.tidy(28)
    assert len(history.runs()) == 2
    shard = digest(0)[:2]
    assert len(glob.glob(f"{tmp_path}/h/*/shard={shard}")) == 1


def _base3(n):
    return (_base3(n // 3) if n >= 3 else "") + str(n % 3)


def test_known_hashes_are_those_of_earlier_batches(spark, tmp_path):
    history = HashHistory(spark, f"{tmp_path}/h", 2)
    for n in range(5):
        history.add(rows(spark, batch(n)), n)
    asked = spark.createDataFrame([(digest(i),) for i in (0, 7, 7, 15, 18, 99)] + [(None,)], "text_hash string")
    for before in range(6):
        want = sorted(digest(i) for i in (0, 7, 15, 18) if i < 4 * before)
        assert ids(history.known(asked, before)) == want
    assert history.known(asked.limit(0), 5).count() == 0


def test_a_batch_that_is_run_again_gives_the_same_history(spark, tmp_path):
    history = HashHistory(spark, f"{tmp_path}/h", 2)
    for n in range(4):
        history.tidy(n)
        history.add(rows(spark, batch(n)), n)
    # The last batch had written its merges, but was not committed; what it needs is there.
    history.tidy(3)
    assert ids(history.known(rows(spark, range(20)), 3)) == sorted(map(digest, range(12)))
    history.add(rows(spark, batch(3)), 3)
    assert ids(history.hashes(history.cover(4))) == sorted(map(digest, range(16)))
    history.tidy(4)
    assert [(r.first, r.last) for r in history.runs()] == [(0, 3)]


WRITES = ["batch_id=3", "merged=2-3", "merged=0-3"]  # of batch 3, in this order


@pytest.mark.parametrize("lost", WRITES)
def test_a_write_that_breaks_off_counts_for_nothing(spark, tmp_path, lost):
    history = HashHistory(spark, f"{tmp_path}/h", 2)
    for n in range(4):
        history.tidy(n)
        history.add(rows(spark, batch(n)), n)
    for name in WRITES[WRITES.index(lost) :]:
        os.remove(f"{tmp_path}/h/{name}/_SUCCESS")
        for made in glob.glob(f"{tmp_path}/h/{name}/**/*.parquet", recursive=True)[:1]:
            with open(made, "w") as f:
                f.write("half")
    history.tidy(3)
    assert ids(history.known(rows(spark, range(20)), 3)) == sorted(map(digest, range(12)))
    history.add(rows(spark, batch(3)), 3)
    assert ids(history.hashes(history.cover(4))) == sorted(map(digest, range(16)))


def test_batches_without_rows_and_a_fanout_of_one(spark, tmp_path):
    history = HashHistory(spark, f"{tmp_path}/h", 2)
    for n in range(4):
        history.add(rows(spark, batch(0) if n == 1 else []), n)
    assert ids(history.hashes(history.cover(4))) == sorted(map(digest, batch(0)))
    assert ids(history.known(rows(spark, [2, 50]), 4)) == [digest(2)]
    with pytest.raises(ValueError):
        HashHistory(spark, "x", 1)
