"""Answers by key, kept in buckets: looked up without moving the store, added to by
writing the new ones only.

A generation is a folder of Parquet files in a fixed number of buckets by key. An upsert
appends files with the rows that are new or changed, under the next version; the row of
the greatest version counts. After many versions the rows that count are written once
more into the next generation. A generation is there when its write has ended, so a merge
that breaks off leaves the one before in force, and readers of that are not disturbed.

One writer at a time. An upsert that broke off has added nothing or all; to run it again
is safe, as rows that are there already are not written twice.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import release
from .joins import skew_join

VERSION = "_version"
MOST_VERSIONS = 32  # of a generation: files of a bucket that a lookup opens
GENERATION = re.compile(r"gen-(\d{6})-b(\d+)$")


@dataclass(frozen=True)
class AnswerStore:
    """A store below `path`; made by `create` or `attach`. `table` is its current
    generation in this session's catalog."""

    spark: SparkSession
    path: str
    key: str
    table: str
    number: int
    buckets: int

    @staticmethod
    def create(rows: DataFrame, path: str, key: str = "cache_key", buckets: int = 200) -> AnswerStore:
        """A new store of these rows, one per key; of rows that repeat a key one stays, null keys
        go. An empty table makes an empty store. A store that is there already is an error."""
        spark = rows.sparkSession
        if _generations(spark, path):
            raise ValueError(f"there is a store below {path}")
        rest = [c for c in rows.columns if c != key]
        once = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.first(F.struct(*rest)).alias("_row"))
        once = once.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest], F.lit(0).alias(VERSION))
        # Kept beside the generations: one without rows has no file to tell its columns.
        told = spark.createDataFrame([(once.schema.json(),)], "schema string")
        told.coalesce(1).write.mode("overwrite").text(f"{path}/schema")
        return _write_generation(once, path, key, 1, buckets)

    @staticmethod
    def attach(spark: SparkSession, path: str, key: str = "cache_key") -> AnswerStore:
        """The store below `path` as it stands, also in a session that did not write it."""
        found = _generations(spark, path)
        if not found:
            raise ValueError(f"no store below {path}")
        number, buckets = max(found)
        told = json.loads(spark.read.text(f"{path}/schema").first()[0])
        return _registered(spark, T.StructType.fromJson(told), path, key, number, buckets)

    def read(self) -> DataFrame:
        """(key, ...), a row per key. Counted off inside the buckets: nothing moves."""
        rows = self.spark.table(self.table)
        rest = [c for c in rows.columns if c not in (self.key, VERSION)]
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), VERSION).alias("_row"))
        return last.select(self.key, *[F.col(f"_row.{c}").alias(c) for c in rest])

    def _keys(self, rows: DataFrame) -> DataFrame:
        """The distinct keys of the rows, dealt like the buckets."""
        return rows.select(self.key).filter(F.col(self.key).isNotNull()).distinct().repartition(self.buckets, self.key)

    def misses(self, rows: DataFrame) -> DataFrame:
        """The distinct keys of the rows that have no answer."""
        return self._keys(rows).join(self.read().select(self.key), self.key, "left_anti")

    def answers(self, rows: DataFrame) -> DataFrame:
        """The stored rows of the keys that the rows hold."""
        return self._keys(rows).join(self.read(), self.key)

    def lookup(self, rows: DataFrame, spread: str) -> DataFrame:
        """Rows with the stored columns and `hit`. Distinct keys go to the buckets; their
        answers come back to the rows by a join that splits hot keys."""
        found = self.answers(rows).withColumn("_hit", F.lit(True))
        joined = skew_join(rows, found, [self.key], [spread], how="left")
        return joined.withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")

    def upsert(self, answers: DataFrame) -> AnswerStore:
        """Adds the answers, one per key, and replaces older ones; returns the store as it
        then is. Rows equal to what is stored are not written; a key that comes twice is an
        error. Columns that the answers lack are null."""
        schema = self.spark.table(self.table).schema
        named = [f for f in schema if f.name != VERSION]
        known = {c for c in answers.columns}
        cells = [(F.col(f.name) if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name) for f in named]
        given = answers.filter(F.col(self.key).isNotNull()).select(*cells)
        rest = [f.name for f in named if f.name != self.key]
        twice = F.raise_error(F.concat(F.lit("more than one answer for "), F.col(self.key).cast("string")))
        once = given.groupBy(self.key).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("_row"))
        # The count is read by the filter, so the check cannot be pruned away.
        once = once.filter(F.when(F.col("_n") == 1, F.lit(True)).otherwise(twice.cast("boolean")))
        stored = self.read().select(self.key, F.struct(*rest).alias("_old"))
        fresh = once.repartition(self.buckets, self.key).join(stored, self.key, "left")
        fresh = fresh.filter(F.col("_old").isNull() | ~F.col("_row").eqNullSafe(F.col("_old")))
        last = self.spark.table(self.table).agg(F.coalesce(F.max(VERSION), F.lit(0))).first()[0]
        rows = fresh.select(self.key, *[F.col(f"_row.{c}").alias(c) for c in rest], F.lit(last + 1).alias(VERSION))
        rows.select(*schema.names).write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)
        return self.merge() if last + 1 >= MOST_VERSIONS else self

    def merge(self) -> AnswerStore:
        """The rows that count, written once more as the next generation."""
        rows = self.read().withColumn(VERSION, F.lit(0))
        rows = rows.select(*self.spark.table(self.table).columns)
        return _write_generation(rows, self.path, self.key, self.number + 1, self.buckets)

    def drop_older(self) -> None:
        """Removes generations before this one, once nobody reads them."""
        older = [g for g in _generations(self.spark, self.path, whole=False) if g[0] < self.number]
        release(self.spark, [_folder(self.path, *g) for g in older])


def _folder(path: str, number: int, buckets: int) -> str:
    return f"{path}/gen-{number:06d}-b{buckets}"


def _generations(spark: SparkSession, path: str, whole: bool = True) -> list[tuple[int, int]]:
    """(number, buckets) of the generations below `path`, of those written to the end."""
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in fs.listStatus(base) if fs.exists(base) else []:
        match = GENERATION.search(status.getPath().getName())
        done = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if match and (not whole or fs.exists(done)):
            found.append((int(match[1]), int(match[2])))
    return found


def _registered(
    spark: SparkSession, schema: T.StructType, path: str, key: str, number: int, buckets: int
) -> AnswerStore:
    """The generation's folder as a bucketed table of this session's catalog."""
    table = f"answers_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(
        f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
        f"INTO {buckets} BUCKETS LOCATION '{_folder(path, number, buckets)}'"
    )
    return AnswerStore(spark, path, key, table, number, buckets)


def _write_generation(rows: DataFrame, path: str, key: str, number: int, buckets: int) -> AnswerStore:
    """A task per bucket writes one file. What an attempt before left unfinished under
    this number goes first."""
    spark = rows.sparkSession
    unfinished = set(_generations(spark, path, whole=False)) - set(_generations(spark, path))
    release(spark, [_folder(path, *g) for g in unfinished if g[0] == number])
    store = _registered(spark, rows.schema, path, key, number, buckets)
    rows.repartition(buckets, key).write.insertInto(store.table)
    spark.catalog.refreshTable(store.table)
    return store
