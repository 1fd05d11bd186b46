"""Deduplication of a stream inside the watermark: copies, late rows, restarts."""

from __future__ import annotations

import json
import os

import pytest

from kinfold.streaming.dedup_stream import dedup_stream

SCHEMA = "id long, text_hash string, ts timestamp"


@pytest.fixture
def place(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    count = iter(range(100))

    def put(rows):
        number = next(count)
        path = tmp_path / "in" / f"f{number:03d}.json"
        with open(path, "w") as f:
            for i, h, hour in rows:
                ts = None if hour is None else f"2026-01-{1 + hour // 24:02d}T{hour % 24:02d}:00:00Z"
                f.write(json.dumps({"id": i, "text_hash": h, "ts": ts}) + "\n")
        os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))  # files are taken by their time

    def run():
        base = str(tmp_path)
        args = [f"{base}/in", f"{base}/out", f"{base}/state", SCHEMA, "ts", "2 hours", ["text_hash"]]
        dedup_stream(spark, *args, files_per_batch=1).awaitTermination()
        return sorted(r.id for r in spark.read.schema(SCHEMA).parquet(f"{base}/out").collect())

    return put, run, tmp_path


def test_copies_late_rows_and_nulls(place):
    put, run, _ = place
    put([(1, "a", 0), (2, "b", 0), (3, None, 0), (4, "c", None)])
    put([(5, "a", 1), (6, None, 1), (7, "d", 1)])  # copies of a and of null inside the delay
    put([(8, "e", 10)])  # the watermark goes to hour 8
    put([(9, "f", 11)])
    put([(10, "a", 12), (11, "g", 3), (12, "d", 12), (13, "f", 12)])  # a, d forgotten; g too late; f a copy
    assert run() == [1, 2, 3, 7, 8, 9, 10, 12]


def test_a_second_run_remembers_and_a_replay_adds_nothing(place):
    put, run, base = place
    put([(1, "a", 0), (2, "b", 1)])
    assert run() == [1, 2]
    put([(3, "b", 2), (4, "c", 2)])
    assert run() == [1, 2, 4]
    assert run() == [1, 2, 4]
    last = max(os.listdir(base / "state" / "commits"), key=lambda n: int(n) if n.isdigit() else -1)
    for name in (last, f".{last}.crc"):  # the commit of the last batch was lost
        os.remove(base / "state" / "commits" / name)
    assert run() == [1, 2, 4]
