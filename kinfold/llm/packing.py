"""Mixture-controlled packing of token streams into sequences of equal length.

Each source is a queue of documents. Windows of a fixed number of tokens are
served from the queues by deficit round-robin: in every window a queue is owed
its quota (window size times its share), gives the whole tokens of what it is
owed so far, and carries the fraction on. Served so far is then the floor of
windows times quota, which needs no walk from the first window: any task knows
the state of all queues at any window, so deficits carry on across windows and
partitions without one task seeing the whole stream. A queue that runs dry drops
out and its share goes to the others. The windows stand one after another, and
sequences are cut from this stream every `length` tokens; only the last one can
be short.
"""

from __future__ import annotations

import gc
from bisect import bisect_right
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .byte_tokens import byte_tokens
from .texts import slices, strings

MAX_QUEUES = 256  # more are planned in tables instead of a broadcast, with the same result
BLOCK = 4096  # windows whose sizes are summed up in one group
WEIGHT = 1_000_000  # shares are taken as whole millionths
OTHER = "other"


class Schedule:
    """How many tokens each queue has given before any window."""

    def __init__(self, names: list[str], totals: list[int], window: int, shares: Mapping[str, float] | None):
        self.names, self.totals = names, totals
        self.starts: list[int] = []  # first window of each phase
        self.phases: list[tuple[list[int], list[int], int]] = []  # served before, quota and its divisor
        served, at = [0] * len(names), 0
        weights = [round(WEIGHT * (shares or {}).get(n, 0)) for n in names]
        while any(s < t for s, t in zip(served, totals, strict=True)):
            left = [t - s for s, t in zip(served, totals, strict=True)]
            owed = [w if rest else 0 for w, rest in zip(weights, left, strict=True)]
            if sum(owed):
                quota, divisor = [w * window for w in owed], sum(owed)
                windows = min(-(-rest * divisor // q) for rest, q in zip(left, quota, strict=True) if q)
            else:  # no share given: in proportion to what is left
                quota, divisor = left, -(-sum(left) // window)
                windows = divisor
            self.starts.append(at)
            self.phases.append((served, quota, divisor))
            at += windows
            served = self.served(at)
        self.windows = at
        self.starts.append(at)
        self.phases.append((served, [0] * len(names), 1))
        self.layouts: dict[int, tuple[list[int], list[int], list[int]]] = {}

    def of(self, queue: int, window: int) -> int:
        """Tokens that a queue has given before this window."""
        phase = bisect_right(self.starts, window) - 1
        before, quota, divisor = self.phases[phase]
        return min(self.totals[queue], before[queue] + (window - self.starts[phase]) * quota[queue] // divisor)

    def served(self, window: int) -> list[int]:
        return [self.of(q, window) for q in range(len(self.names))]

    def find(self, queue: int, position: int) -> int:
        """The window that takes this token of a queue."""
        low, high = 0, self.windows - 1
        while low < high:
            middle = (low + high) // 2
            if self.of(queue, middle + 1) <= position:
                low = middle + 1
            else:
                high = middle
        return low

    def layout(self, window: int) -> tuple[list[int], list[int], list[int]]:
        """Per queue: served before the window, served after it, and where its
        part of the window stands in the stream."""
        if window not in self.layouts:
            if len(self.layouts) > 64:
                self.layouts.clear()
            before, after = self.served(window), self.served(window + 1)
            places, at = [], sum(before)
            for b, a in zip(before, after, strict=True):
                places.append(at)
                at += a - b
            self.layouts[window] = before, after, places
        return self.layouts[window]

    def cut(self, queue: int, begin: int, end: int, length: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(tokens before, tokens, sequence, offset, window) of each piece of a queue's
        tokens [begin, end)."""
        at, window = begin, -1
        while at < end:
            window = self.find(queue, at) if window < 0 else window + 1
            before, after, places = self.layout(window)
            stop = min(end, after[queue])
            place = places[queue] + at - before[queue]
            while at < stop:
                take = min(stop - at, length - place % length)
                yield at - begin, take, place // length, place % length, window
                at, place = at + take, place + take


def pack(
    df: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    length: int = 2048,
    end_id: int = 1,
    window: int = 64 * 2048,
    shares: Mapping[str, float] | None = None,
) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset, queue, window), a row per piece.

    A document is its token ids followed by `end_id`; null text is empty, so
    every row, repeated ones too, gives at least one token. `ids` holds the
    piece's ids as little-endian 32-bit numbers. `shares` are target token
    shares per source; sources without one follow when the others are dry, in
    proportion to their tokens, as all do where `shares` is not given. A null
    source counts as the empty name. Other columns are ignored; an empty table
    gives no rows.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType
    named = F.coalesce(df[source_col].cast("string"), F.lit(""))
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"), _queue(named, shares).alias("queue"))
    staged = materialize(_tokenize(rows, tokenizer, end_id, kind), "packing-tokens")

    # What each partition adds to each queue: as many rows as partitions times queues.
    added = staged.groupBy("queue", "part").agg(F.sum("n_tokens").alias("tokens"))
    before = F.sum("tokens").over(
        Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    )
    bases = materialize(
        added.select("queue", "part", "tokens", F.coalesce(before, F.lit(0)).alias("base")), "packing-bases"
    )
    sums = materialize(bases.groupBy("queue").agg(F.sum("tokens").alias("total")), "packing-totals")
    if not shares and sums.count() > MAX_QUEUES:
        return _pack_by_tables(staged, bases, sums, kind, length, window)
    totals = {r[0]: r[1] for r in sums.collect()}  # at most MAX_QUEUES, or the queues of the given shares
    names = sorted(totals)
    schedule = Schedule(names, [totals[n] for n in names], window, shares)
    numbers = {n: i for i, n in enumerate(names)}
    shared = spark.sparkContext.broadcast((schedule, numbers))

    fields = _fields(kind)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, number = shared.value
        for whole in batches:
            for batch in slices(whole, "ids"):
                out: list[list] = [[] for _ in range(7)]
                rows: list[int] = []
                columns = [batch.column(n).to_pylist() for n in ("ids", "queue", "at", "n_tokens")]
                for row, (ids, queue, at, n) in enumerate(zip(*columns, strict=True)):
                    wide = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                    for start, take, sequence, offset, w in plan.cut(number[queue], at, at + n, length):
                        rows.append(row)
                        piece = start, take, wide[4 * start : 4 * (start + take)], n, sequence, offset, w
                        for column, value in zip(out, piece, strict=True):
                            column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
                made = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
                taken = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(taken), *made[:6], batch.column("queue").take(taken), made[6]],
                    names=[f.name for f in fields],
                )

    placed = staged.join(bases.select("queue", "part", "base"), ["queue", "part"])
    placed = placed.select("id", "queue", "n_tokens", "ids", (F.col("base") + F.col("at")).alias("at"))
    return placed.mapInArrow(cut, T.StructType(fields))


def piece_columns(packed: DataFrame) -> DataFrame:
    """The pieces of `pack` with a checksum in place of their ids."""
    return packed.select(
        F.col("id").alias("doc_id"),
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def _fields(kind: T.DataType) -> list[T.StructField]:
    return [
        T.StructField("id", kind),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("queue", T.StringType()),
        T.StructField("window", T.LongType()),
    ]


def _queue(named: Column, shares: Mapping[str, float] | None) -> Column:
    return F.when(named.isin([*shares]), named).otherwise(F.lit(OTHER)) if shares else named


def _pack_by_tables(
    staged: DataFrame, bases: DataFrame, sums: DataFrame, kind: T.DataType, length: int, window: int
) -> DataFrame:
    """What Schedule gives without shares, for any number of queues: a queue of n tokens
    has given w * n // windows of them before window w, so a task needs the queue's
    total only; where its part of a window stands comes from a table by queue and window."""
    windows = -(-sums.agg(F.sum("total")).first()[0] // window)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for queue, total in zip(batch.column("queue").to_pylist(), batch.column("total").to_pylist(), strict=True):
                for low in range(0, min(total, windows), 8192):
                    numbers = range(low, min(low + 8192, total, windows))
                    # Fewer tokens than windows: only the windows that take one.
                    at = [*numbers] if total >= windows else [-(-(k + 1) * windows // total) - 1 for k in numbers]
                    given = [(w * total // windows, (w + 1) * total // windows) for w in at]
                    columns = at, [a for a, _ in given], [b - a for a, b in given]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([queue] * len(at), pa.string()), *[pa.array(c, pa.int64()) for c in columns]],
                        names=["queue", "window", "before", "tokens"],
                    )

    given = materialize(sums.mapInArrow(parts, "queue string, window long, before long, tokens long"), "packing-parts")
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    sized = given.groupBy("window").agg(F.sum("tokens").alias("size"))
    sized = materialize(sized.withColumn("block", F.expr(f"window div {BLOCK}")), "packing-windows")
    in_block = F.coalesce(F.sum("size").over(earlier.partitionBy("block").orderBy("window")), F.lit(0))
    of_block = F.coalesce(F.sum("all").over(earlier.orderBy("block")), F.lit(0))  # a row per BLOCK windows
    blocks = sized.groupBy("block").agg(F.sum("size").alias("all")).select("block", of_block.alias("first"))
    begins = sized.select("window", "block", in_block.alias("inside")).join(blocks, "block")
    # A window has no more queues than tokens.
    among = F.coalesce(F.sum("tokens").over(earlier.partitionBy("window").orderBy("queue")), F.lit(0))
    laid = given.withColumn("among", among).join(begins, "window")
    place = F.col("first") + F.col("inside") + F.col("among") - F.col("before")
    laid = materialize(laid.select("queue", "window", place.alias("shift")), "packing-places")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "ids"):
                out: list[tuple] = []
                columns = [batch.column(n).to_pylist() for n in ("ids", "queue", "at", "n_tokens", "total")]
                for row, (ids, queue, begin, n, total) in enumerate(zip(*columns, strict=True)):
                    at = begin
                    while at < begin + n:
                        w = -(-(at + 1) * windows // total) - 1  # the window that takes this token
                        stop = min(begin + n, (w + 1) * total // windows)
                        out.append((row, at - begin, at, ids[2 * (at - begin) : 2 * (stop - begin)], n, queue, w))
                        at = stop
                taken, *made = [*zip(*out, strict=True)]
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(taken)), *[pa.array(c, k) for c, k in zip(made, kinds, strict=True)]],
                    names=["id", "start", "at", "ids", "doc_tokens", "queue", "window"],
                )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in _fields(kind)]
        for whole in batches:
            for batch in slices(whole, "ids"):
                out: list[tuple] = []
                columns = [batch.column(n).to_pylist() for n in ("start", "ids", "place")]
                for row, (start, ids, place) in enumerate(zip(*columns, strict=True)):
                    wide, at = np.frombuffer(ids, "<u2").astype("<u4"), 0
                    while at < len(wide):
                        take = min(len(wide) - at, length - place % length)
                        piece = wide[at : at + take].tobytes()
                        out.append((row, start + at, take, piece, place // length, place % length))
                        at, place = at + take, place + take
                taken, *made = [*zip(*out, strict=True)]
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
                start, take, piece, sequence, offset = (pa.array(c, k) for c, k in zip(made, kinds, strict=True))
                of = {n: batch.column(n).take(pa.array(taken)) for n in ("id", "doc_tokens", "queue", "window")}
                yield pa.RecordBatch.from_arrays(
                    [of["id"], start, take, piece, of["doc_tokens"], sequence, offset, of["queue"], of["window"]],
                    names=names,
                )

    head = [T.StructField("id", kind)]
    tail = T.StructType.fromDDL("start long, at long, ids binary, doc_tokens long, queue string, window long").fields
    placed = staged.join(bases.select("queue", "part", "base").join(sums, "queue"), ["queue", "part"])
    placed = placed.select("id", "queue", "n_tokens", "ids", "total", (F.col("base") + F.col("at")).alias("at"))
    by_window = placed.mapInArrow(split, T.StructType([*head, *tail])).join(laid, ["queue", "window"])
    located = by_window.withColumn("place", F.col("shift") + F.col("at")).drop("shift", "at")
    return located.mapInArrow(cut, T.StructType(_fields(kind)))


def _tokenize(rows: DataFrame, tokenizer: str, end_id: int, kind: T.DataType) -> DataFrame:
    """(id, queue, part, at, n_tokens, ids): `at` counts the tokens before it in
    its queue and partition."""
    fields = [
        T.StructField("id", kind),
        T.StructField("queue", T.StringType()),
        T.StructField("part", T.LongType()),
        T.StructField("at", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.freeze()
        part = TaskContext.get().partitionId()
        so_far: dict[str, int] = {}
        tokens = byte_tokens(tokenizer)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, begins = tokens.ids(strings(batch.column("text")))
                counts = np.diff(begins) + 1
                full = np.insert(ids, begins[1:], end_id)
                edges = np.concatenate([[0], np.cumsum(counts)])
                at = []
                for queue, n in zip(batch.column("queue").to_pylist(), counts.tolist(), strict=True):
                    at.append(so_far.get(queue, 0))
                    so_far[queue] = at[-1] + n
                data = full.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"),
                        batch.column("queue"),
                        pa.array(np.full(batch.num_rows, part, np.int64)),
                        pa.array(at, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array([data[2 * a : 2 * b] for a, b in zip(edges, edges[1:], strict=False)], pa.binary()),
                    ],
                    names=[f.name for f in fields],
                )

    return rows.mapInArrow(run, T.StructType(fields))
