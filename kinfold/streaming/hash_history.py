"""Hashes accepted by the batches of a stream, as runs that are merged level by level.

A batch adds one run, few files sorted by hash. When the last `fanout` batches (or
`fanout` times as many, and so on) are complete, their runs are written once more as one
run in folders by the first digits of the hash. A reader takes the longest complete runs
that cover the batches before it: after n batches these are the digits of n in base
`fanout`, added up, so that every folder is opened a few times, not n times. A row is
written once per level.

A run counts once its write has ended, so a merge that breaks off leaves the runs it was
made from in force. A batch that is run again reads runs of earlier batches only, writes
its run and the merges that end with it anew, and nothing it could need has been removed:
runs go when a later batch begins, which tells that the merge's batch was committed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sketch import key_sketch
from ..session import materialize, release
from ..sources.files import path_exists

FANOUT = 8  # runs of a level that make one of the next
SHARD_DIGITS = 2  # of the hash, that name a folder of a merged run
RUN = re.compile(r"(?:batch_id=(\d+)|merged=(\d+)-(\d+))$")


@dataclass(frozen=True)
class Run:
    """The hashes of batches `first` to `last`."""

    first: int
    last: int
    path: str
    merged: bool


@dataclass(frozen=True)
class HashHistory:
    """A history below `path`. One writer at a time; batches come in order, from number 0."""

    spark: SparkSession
    path: str
    fanout: int = FANOUT

    def __post_init__(self):
        if self.fanout < 2:
            raise ValueError("a fanout of at least 2")

    def runs(self) -> list[Run]:
        """All complete runs."""
        if not path_exists(self.spark, self.path):
            return []
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        system = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        out = []
        for status in system.listStatus(folder):
            found = RUN.match(status.getPath().getName())
            if found and path_exists(self.spark, f"{status.getPath()}/_SUCCESS"):
                first = int(found[1] or found[2] or 0)
                last = int(found[3]) if found[3] else first
                out.append(Run(first, last, str(status.getPath()), found[1] is None))
        return out

    def cover(self, before: int) -> list[Run]:
        """The fewest complete runs with the batches before this one, in order."""
        out: list[Run] = []
        for run in sorted(self.runs(), key=lambda r: (r.first, -r.last)):
            if run.last < before and run.first > (out[-1].last if out else -1):
                out.append(run)
        return out

    def hashes(self, runs: list[Run], shards: list[str] | None = None) -> DataFrame:
        """(text_hash) of these runs, in these shards only where they are kept apart."""
        parts = [self.spark.createDataFrame([], "text_hash string")]
        if single := [r.path for r in runs if not r.merged]:
            reader = self.spark.read.schema("text_hash string").option("recursiveFileLookup", True)
            parts.append(reader.parquet(*single))
        for run in runs:
            if run.merged:
                apart = self.spark.read.schema("text_hash string, shard string").parquet(run.path)
                apart = apart if shards is None else apart.filter(F.col("shard").isin(shards))
                parts.append(apart.select("text_hash"))
        return reduce(DataFrame.unionByName, parts[1:] or parts)

    def known(self, rows: DataFrame, before: int) -> DataFrame:
        """(text_hash) of earlier batches that `rows` have too, null hashes aside.

        Only shards that the batch has hashes for are read, at most 256 names come to the
        driver for that; a sketch of the batch's hashes, of a fixed size, drops most other
        rows in the scan, and the join decides.
        """
        runs = self.cover(before)
        if not runs:
            return self.spark.createDataFrame([], "text_hash string")
        wanted = materialize(rows.select("text_hash").filter("text_hash IS NOT NULL").distinct(), "wanted")
        shards = [r[0] for r in wanted.select(_shard()).distinct().collect()]
        old = self.hashes(runs, shards).filter(key_sketch(wanted, "text_hash").may_hold("text_hash"))
        return old.join(wanted, "text_hash", "left_semi")

    def add(self, hashes: DataFrame, batch_id: int) -> None:
        """Write a batch's (text_hash), and the merges that end with it."""
        laid = hashes.select("text_hash").filter("text_hash IS NOT NULL").repartitionByRange("text_hash")
        latest = Run(batch_id, batch_id, f"{self.path}/batch_id={batch_id}", False)
        laid.sortWithinPartitions("text_hash").write.mode("overwrite").parquet(latest.path)
        earlier, size = self.cover(batch_id), self.fanout
        while (batch_id + 1) % size == 0:
            first = batch_id + 1 - size
            merged = Run(first, batch_id, f"{self.path}/merged={first}-{batch_id}", True)
            parts = [r for r in earlier if first <= r.first and r.last < latest.first]
            rows = self.hashes([*parts, latest])
            # By range, so that a task has few shards and a large shard several tasks.
            rows = rows.withColumn("shard", _shard()).repartitionByRange("shard", "text_hash")
            rows = rows.sortWithinPartitions("shard", "text_hash")
            rows.write.mode("overwrite").partitionBy("shard").parquet(merged.path)
            latest, size = merged, size * self.fanout

    def tidy(self, batch_id: int) -> None:
        """Remove runs that lie inside a longer one, once a later batch than its last begins."""
        runs = self.runs()
        whole = [r for r in runs if r.merged and r.last < batch_id]
        inside = [
            r.path
            for r in runs
            if any(w.first <= r.first and r.last <= w.last and w.last - w.first > r.last - r.first for w in whole)
        ]
        release(self.spark, inside)


def _shard():
    return F.substring("text_hash", 1, SHARD_DIGITS).alias("shard")
