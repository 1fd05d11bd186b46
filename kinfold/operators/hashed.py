"""Logistic regressions on hashed text features, any number of them at once.

Terms are hashed with a sign into a space of fixed width, so there is no vocabulary: what
a fit keeps is one vector of document frequencies and one of coefficients, and all rows
take part. Many fits share the rows: each row says by a flag per fit whether it is trained
on. Every fit runs its own L-BFGS; the points that all of them want to know the objective
at are evaluated in one pass over the rows, so the passes are those of the slowest fit,
for as many folds and seeds as fit into a matrix of bounded size, and again for the next.

A pass leaves one matrix of width x fits per task, and has as many tasks as there are cores.
Matrices are cut into chunks and summed by Spark as they come in; the driver gets the one sum.
Rows lie in blocks of sparse counts on disk, so that no heap is filled with them. A column of
a matrix belongs to a fit; the last EXTRA rows hold what is no slot.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import forget_shuffles, materialize, small_batches

CHUNK = 4096  # rows of a matrix that are summed together
BLOCK_ENTRIES = 1 << 20  # counts of a block; a longer document is a block of its own
CACHED = 1 << 16  # numbers that are gathered at a time
LONG = 128  # entries of a sum that is taken alone; shorter ones are taken by their length
EXTRA = 2  # rows of a matrix beside the slots
ROUNDING = 1e-12  # relative, of a value summed over the rows
KEPT_BYTES = 32 << 20  # of a pass's matrices that may stay on the executors' disks for a while
TOGETHER = 1 << 21  # numbers of a matrix of slots x fits: more fits are solved in groups
LEAST_MEMORY, MEMORY = 10, 23  # pairs of steps that L-BFGS remembers
HISTORY_BYTES = 271 << 20  # of all fits' pairs and other vectors, beyond LEAST_MEMORY pairs of each
OTHERS = 4  # pairs' worth of vectors that a solver holds beside its pairs
BLOCKS = "n int, begins binary, slots binary, counts binary, y binary, fits binary"


@dataclass(frozen=True)
class HashedSpec:
    """2 ** bits slots; C, tolerance of the largest gradient component per row and number
    of steps of the solver; document frequencies of a slot that is used."""

    bits: int = 18
    c: float = 1.0
    tol: float = 1e-4
    max_iter: int = 2000
    min_df: int = 2
    max_df: float = 0.95

    @property
    def width(self) -> int:
        return 1 << self.bits


@dataclass(frozen=True)
class HashedModels:
    """Fitted models, one column each. `gradient`: largest component per row at the end."""

    spec: HashedSpec
    idf: np.ndarray = field(repr=False)
    beta: np.ndarray = field(repr=False)
    intercept: np.ndarray
    n_rows: np.ndarray
    iterations: np.ndarray
    gradient: np.ndarray
    passes: int

    def predict(self, rows: DataFrame, keep: list[str], tested: Column | None = None) -> DataFrame:
        """`keep`, model (from 0), score and pred, 1 or 0, for each row and each model of
        which the flag in the array `tested` holds; without it, for all. Rows have `terms`."""
        kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema]
        everyone = F.array_repeat(F.lit(True), len(self.intercept))
        wanted = rows.select(*keep, _hashes(rows["terms"]), (everyone if tested is None else tested).alias("_tested"))
        arrays = rows.sparkSession.sparkContext.broadcast((self.idf, self.idf * self.beta, self.intercept))
        predicted = partial(_predict, arrays, self.spec.width, len(keep))
        return wanted.mapInArrow(predicted, f"{', '.join(kinds)}, model int, score double, pred int")


def fit_hashed(rows: DataFrame, fits: Column, spec: HashedSpec) -> HashedModels:
    """Balanced logistic regressions on the rows' `terms` (array of strings) and `y`.

    `fits` is an array of one flag per model: whether the row trains it. Weights of a row
    are n / (2 * n_class) in each fit, the inverse document frequencies those of its
    training rows, vectors are of unit length. Each model minimises its weighted mean loss
    plus |beta|^2 / (2 C n); intercepts are free. A fit without both classes is an error.
    """
    small_batches(rows.sparkSession)
    flagged = rows.select(_hashes(rows["terms"]), rows["y"].cast("double").alias("y"), fits.alias("_fits"))
    blocks = materialize(flagged.mapInArrow(partial(_blocks, spec.width), BLOCKS), "hashed-blocks", large_rows=True)
    n_fits = flagged.agg(F.max(F.size("_fits"))).first()[0] or 0
    forget_shuffles(rows.sparkSession)
    groups = together(spec.width, n_fits)
    classes, idf = np.zeros((2, n_fits)), np.zeros((spec.width, n_fits))
    for some in groups:
        found = _summed(blocks, partial(_frequencies, some), spec.width, len(some))
        df, classes[:, some] = found[: spec.width], found[spec.width :]
        n = classes[:, some].sum(0)
        used = (df >= spec.min_df) & (df <= spec.max_df * n)
        idf[:, some] = np.where(used, np.log((1 + n) / (1 + df)) + 1, 0.0)
        del found, df, used
    if not n_fits or not classes.all():
        raise ValueError(f"training rows hold one class only: {classes.astype(int).tolist()} negative, positive per fit")
    n = classes.sum(0)
    weights = n / (2 * classes)
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(idf)
    ready = blocks.mapInArrow(partial(_with_norms, held, spec.width), f"{BLOCKS}, norms binary, by_slot binary")
    ready = ready.persist(StorageLevel.DISK_ONLY)
    try:
        found, passes, memory = [], 0, remembered(spec.width, n_fits)
        for some in groups:
            curved = _summed(ready, partial(_curvatures, some, weights), spec.width, len(some))
            scales = [_scale(x[:-EXTRA] * idf[:, k] ** 2 / n[k], spec.c * n[k]) for k, x in zip(some, curved.T, strict=True)]
            del curved
            solvers = [lbfgs(np.zeros(spec.width + 1), spec.tol, spec.max_iter, memory, scale) for scale in scales]
            solved, more = _solve(ready, dict(zip(some, solvers, strict=True)), idf, weights, n, spec)
            found, passes = found + solved, passes + more
    finally:
        ready.unpersist()
        held.unpersist()
    point = np.stack([f.x for f in found], axis=1)
    return HashedModels(
        spec,
        idf,
        point[:-1],
        point[-1],
        n.astype(int),
        np.array([f.steps for f in found]),
        np.array([np.abs(f.slope).max() for f in found]),
        passes,
    )


def _solve(
    ready: DataFrame, solvers: dict, idf: np.ndarray, weights: np.ndarray, n: np.ndarray, spec: HashedSpec
) -> tuple[list[Solution], int]:
    """Runs the solvers, by the number of their fit, to their ends; in each round one pass
    answers all that still ask."""
    context = ready.sparkSession.sparkContext
    asked = {k: next(solver) for k, solver in solvers.items()}
    found: dict[int, Solution] = {}
    passes = 0
    while asked:
        passes += 1
        some = sorted(asked)
        of_slots = np.empty((spec.width, len(some)))
        for column, k in enumerate(some):
            np.multiply(idf[:, k], asked[k][:-1], out=of_slots[:, column])
        arrays = context.broadcast((some, of_slots, np.array([asked[k][-1] for k in some]), weights[:, some]))
        del of_slots
        total = _summed(ready, partial(_slopes, arrays, spec.width), spec.width, len(some))
        arrays.destroy()
        for column, k in enumerate(some):
            beta, penalty = asked[k][:-1], 1 / (spec.c * n[k])
            value = total[spec.width, column] / n[k] + penalty / 2 * (beta @ beta)
            slope = total[: spec.width, column] * idf[:, k] / n[k] + penalty * beta
            slope = np.append(slope, total[spec.width + 1, column] / n[k])
            try:
                asked[k] = solvers[k].send((value, slope))
            except StopIteration as end:
                found[k] = end.value
                del asked[k]
    return [found[k] for k in solvers], passes


@dataclass(frozen=True)
class Solution:
    x: np.ndarray
    value: float
    slope: np.ndarray
    steps: int


def together(width: int, n_fits: int) -> list[range]:
    """The fits that share their passes: all, or groups of one size about, so that neither the
    driver nor a task holds more than bounded matrices, whatever the number of fits."""
    groups = -(-n_fits // max(TOGETHER // width, 1))
    edges = [n_fits * g // max(groups, 1) for g in range(groups + 1)]
    return [range(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def remembered(width: int, n_fits: int) -> int:
    """Pairs of steps that each fit remembers: every pass saved is a matrix less that is sent
    to the driver, so as many as help, as long as those of all fits are of bounded size."""
    return min(MEMORY, max(LEAST_MEMORY, HISTORY_BYTES // (8 * (width + 1) * max(n_fits, 1)) - OTHERS))


def _scale(curvature: np.ndarray, c: float) -> np.ndarray:
    """First scale of a fit's steps, from the curvature of its mean loss at zero: its root
    evens out frequent and rare slots, which takes half the passes or less."""
    curvature = np.append(0.25 * curvature + 1 / c, 0.25)
    return (1 / np.sqrt(curvature)).astype(np.float32)


def lbfgs(
    x: np.ndarray, tol: float, max_iter: int, memory: int = MEMORY, scale: np.ndarray | float = 1.0
) -> Generator[np.ndarray, tuple[float, np.ndarray], Solution]:
    """Minimises a smooth convex function: yields points, is sent (value, slope) at them.
    The remembered pairs, and `scale` of each component, only shape the next step; they are
    kept in single precision.

    Ends when the largest component of the slope is at most `tol`, after `max_iter` steps,
    or when rounding hides any further descent.
    """
    value, slope = yield x
    past: deque = deque(maxlen=memory)
    for step in range(max_iter):
        if np.abs(slope).max() <= tol:
            return Solution(x, value, slope, step)
        way = -_times_inverse(slope, past, scale).astype(np.float32)
        fall = way @ slope
        length = 1.0 if past or np.ndim(scale) else min(1.0, 1 / np.abs(slope).sum())
        while True:
            tried = x + length * way
            tried_value, tried_slope = yield tried
            if tried_value <= value + 1e-4 * length * fall:
                break
            # Near the least point values differ by their rounding; there the slope decides.
            if tried_value <= value + ROUNDING * abs(value) and abs(tried_slope @ way) <= 0.9 * abs(fall):
                break
            # The least point of the parabola through what is known, kept inside.
            low = -fall * length**2 / (2 * (tried_value - value - length * fall))
            length = min(max(low, 0.1 * length), 0.5 * length)
            if length * np.abs(way).max() <= 1e-16 * max(1.0, np.abs(x).max()):
                return Solution(x, value, slope, step)
        moved, bent = (tried - x).astype(np.float32), (tried_slope - slope).astype(np.float32)
        if moved @ bent > 1e-16 * (bent @ bent):
            past.append((moved, bent))
        x, value, slope = tried, tried_value, tried_slope
    return Solution(x, value, slope, max_iter)


def _times_inverse(slope: np.ndarray, past: deque, scale: np.ndarray | float = 1.0) -> np.ndarray:
    """The inverse Hessian that the past steps suggest, times the slope."""
    q = slope.copy()
    shares = []
    for moved, bent in reversed(past):
        share = (moved @ q) / (moved @ bent)
        q -= share * bent
        shares.append(share)
    q *= scale
    if past:
        moved, bent = past[-1]
        q *= (moved @ bent) / (bent @ (scale * bent))
    for (moved, bent), share in zip(past, reversed(shares), strict=True):
        q += (share - (bent @ q) / (moved @ bent)) * moved
    return q


def collisions(rows: DataFrame, spec: HashedSpec) -> DataFrame:
    """(n_terms, n_slots, n_shared): distinct terms of the rows, slots they fall into, and
    terms that share their slot with another."""
    terms = rows.select(F.explode("terms").alias("term")).distinct()
    slot = F.pmod(F.xxhash64("term"), F.lit(spec.width)).alias("slot")
    slots = terms.groupBy(slot).agg(F.count(F.lit(1)).alias("n"))
    shared = F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0))
    return slots.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_terms"),
        F.count(F.lit(1)).alias("n_slots"),
        F.coalesce(shared, F.lit(0)).alias("n_shared"),
    )


# --- passes over the blocks ---


def _hashes(terms: Column) -> Column:
    return F.transform(terms, lambda t: F.xxhash64(t)).alias("_hashes")


def _summed(blocks: DataFrame, task: Callable, width: int, n_fits: int) -> np.ndarray:
    """The sum of the matrices to which `task` adds each partition's blocks."""
    total = np.zeros((width + EXTRA, max(n_fits, 1)))
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    parts = blocks.coalesce(cores).mapInArrow(partial(_chunks, task, total.shape), "chunk int, part binary")
    sums = parts.repartition("chunk").mapInArrow(_added, "chunk int, part binary")
    for row in sums.collect():
        part = np.frombuffer(row.part, "<f8").reshape(-1, total.shape[1])
        total[row.chunk * CHUNK : row.chunk * CHUNK + len(part)] = part
    if total.nbytes * cores > KEPT_BYTES:
        del parts, sums
        forget_shuffles(blocks.sparkSession)
    return total


def _chunks(task: Callable, shape: tuple[int, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for k in range(batch.num_rows):
            total = np.zeros(shape) if total is None else total
            task(_Block(batch.slice(k, 1).to_pylist()[0]), total)
    if total is not None:
        for chunk in range(-(-len(total) // CHUNK)):
            part = total[chunk * CHUNK : (chunk + 1) * CHUNK]
            if part.any():
                yield _part(chunk, part.astype("<f8"))


def _part(chunk: int, part: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([chunk], pa.int32()), pa.array([part.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["chunk", "part"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One part per chunk; no more than the sums and a batch are held."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, part in zip(batch.column("chunk").to_pylist(), batch.column("part"), strict=True):
            values = np.frombuffer(part.as_buffer(), "<f8")
            if chunk in sums:
                sums[chunk] += values
            else:
                sums[chunk] = values.copy()
    for chunk, values in sums.items():
        yield _part(chunk, values)


class _Block:
    """Documents as sparse signed counts: entry e belongs to document doc[e]."""

    def __init__(self, row: dict):
        self.n = row["n"]
        begins = np.frombuffer(row["begins"], "<i8")
        self.slots = np.frombuffer(row["slots"], "<i4")
        self.counts = np.frombuffer(row["counts"], "<f4").astype(np.float64)
        self.doc = np.repeat(np.arange(self.n), np.diff(begins))
        self.y = np.frombuffer(row["y"], "<f8")
        self.fits = np.frombuffer(row["fits"], np.uint8).reshape(self.n, -1)
        self.norms = np.frombuffer(row["norms"], "<f8").reshape(self.n, -1) if "norms" in row else None
        self.by_slot = np.frombuffer(row["by_slot"], "<i4") if "by_slot" in row else None

    def per_document(self, of_slots: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
        """Sum of count times value of the slot, for each document and column."""
        counts = self.counts if counts is None else counts
        if of_slots.shape[1] == 1:
            return np.bincount(self.doc, counts * of_slots[self.slots, 0], self.n)[:, None]
        return _sums(self.doc, of_slots, self.slots, counts, self.n)

    def add_per_slot(self, of_documents: np.ndarray, out: np.ndarray, counts: np.ndarray | None = None) -> None:
        """Add the sum of count times value of the document, for each slot and column."""
        counts = self.counts if counts is None else counts
        if of_documents.shape[1] == 1:
            width = len(out) - EXTRA
            out[:width, 0] += np.bincount(self.slots, counts * of_documents[self.doc, 0], width)
            return
        order = _by_slot(self.slots) if self.by_slot is None else self.by_slot
        _sums(self.slots[order], of_documents, self.doc[order], counts[order], len(out), out)


def _by_slot(slots: np.ndarray) -> np.ndarray:
    return np.argsort(slots, kind="stable")


def _sums(
    keys: np.ndarray, values: np.ndarray, at: np.ndarray, counts: np.ndarray, n: int, out: np.ndarray | None = None
) -> np.ndarray:
    """Row k: the sum of counts * values[at] where the key, in order, is k; added to `out`, if
    given. Products of a vector and a matrix: of a long sum alone, of all short sums of the
    same length together, so many that what is gathered stays in the cache."""
    out = np.zeros((n, values.shape[1])) if out is None else out
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    size = np.diff(first, append=len(keys))
    for low in np.flatnonzero(size >= LONG).tolist():
        some = slice(first[low], first[low] + size[low])
        out[keys[first[low]]] += counts[some] @ np.take(values, at[some], axis=0)
    short = np.flatnonzero(size < LONG)
    short = short[np.argsort(size[short], kind="stable")]
    edges = np.searchsorted(size[short], np.arange(1, LONG + 1)).tolist()
    for length, low, high in zip(range(1, LONG), edges[:-1], edges[1:], strict=True):
        step = max(CACHED // (length * max(values.shape[1], 1)), 1)
        for begin in range(low, high, step):
            starts = first[short[begin : min(begin + step, high)]]
            entries = starts[:, None] + np.arange(length)
            gathered = np.take(values, at[entries], axis=0)
            out[keys[starts]] += np.matmul(counts[entries][:, None, :], gathered)[:, 0, :]
    return out


def _sparse(hashes: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begins, slots, counts) of documents: signed counts per slot that are not zero."""
    begins = np.asarray(hashes.offsets, np.int64)
    values = hashes.values.to_numpy(zero_copy_only=False)[begins[0] : begins[-1]]
    n = len(begins) - 1
    doc = np.repeat(np.arange(n), np.diff(begins))
    # The slot is the hash modulo the width, the sign its highest bit.
    keys, inverse = np.unique(doc * width + (values & (width - 1)), return_inverse=True)
    counts = np.bincount(inverse, np.where(values < 0, -1.0, 1.0), len(keys)) if len(keys) else np.zeros(0)
    keys, counts = keys[counts != 0], counts[counts != 0]
    return np.searchsorted(keys, np.arange(n + 1) * width), keys % width, counts


def _filled(column: pa.Array) -> pa.Array:
    """A list column without null lists and without the gaps of a slice."""
    return pa.concat_arrays([column.fill_null(pa.scalar([], column.type))])


def _parts(hashes: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about BLOCK_ENTRIES entries."""
    size = np.diff(np.asarray(hashes.offsets, np.int64))
    part = (np.cumsum(size) - size) // BLOCK_ENTRIES
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    yield from zip(starts.tolist(), [*starts[1:].tolist(), len(size)], strict=True)


def _blocks(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        hashes, fits = _filled(batch.column("_hashes")), batch.column("_fits")
        y = batch.column("y").to_numpy(zero_copy_only=False)
        flags = fits.flatten().fill_null(False).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        for start, stop in _parts(hashes):
            begins, slots, counts = _sparse(hashes.slice(start, stop - start), width)
            row = {
                "n": stop - start,
                "begins": begins.astype("<i8").tobytes(),
                "slots": slots.astype("<i4").tobytes(),
                "counts": counts.astype("<f4").tobytes(),
                "y": y[start:stop].astype("<f8").tobytes(),
                "fits": flags[start:stop].astype(np.uint8).tobytes(),
            }
            yield _one_row(row)


def _one_row(row: dict) -> pa.RecordBatch:
    kinds = [pa.int32() if name == "n" else pa.binary() for name in row]
    arrays = [pa.array([value], kind) for value, kind in zip(row.values(), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, list(row))


def _frequencies(some: range, block: _Block, total: np.ndarray) -> None:
    """Add the documents with each slot, per fit; then rows of class 0 and of class 1."""
    fits = block.fits[:, some].astype(np.float64)
    block.add_per_slot(fits, total, np.ones(len(block.slots)))
    total[-2] += fits[block.y == 0].sum(0)
    total[-1] += fits[block.y == 1].sum(0)


def _norms(block: _Block, idf: np.ndarray) -> np.ndarray:
    squares = block.per_document(idf * idf, block.counts**2)
    return np.where(squares > 0, np.sqrt(squares), 1.0)


def _with_norms(idf, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            block = _Block(row)
            more = {"norms": _norms(block, idf.value).astype("<f8"), "by_slot": _by_slot(block.slots).astype("<i4")}
            yield _one_row(row | {name: value.tobytes() for name, value in more.items()})


def _slopes(arrays, width: int, block: _Block, total: np.ndarray) -> None:
    """Add the slopes of the weighted losses for each slot, before its idf; then the losses
    and the slopes of the intercepts."""
    some, of_slots, intercept, weights = arrays.value
    norms = block.norms[:, some]
    score = block.per_document(of_slots) / norms + intercept
    weight = block.fits[:, some] * np.where(block.y[:, None] == 1, weights[1], weights[0])
    side = np.where(block.y[:, None] == 1, 1.0, -1.0)
    loss = weight * np.logaddexp(0, -side * score)
    residual = -weight * side / (1 + np.exp(np.clip(side * score, -500, 500)))
    block.add_per_slot(residual / norms, total)
    total[width] += loss.sum(0)
    total[width + 1] += residual.sum(0)


def _curvatures(some: range, weights: np.ndarray, block: _Block, total: np.ndarray) -> None:
    """Add the weighted squares of each slot's values, before its idf."""
    weight = block.fits[:, some] * np.where(block.y[:, None] == 1, weights[1, some], weights[0, some])
    block.add_per_slot(weight / block.norms[:, some] ** 2, total, block.counts**2)


def _predict(arrays, width: int, n_keep: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    idf, of_slots, intercept = arrays.value
    for batch in batches:
        if not batch.num_rows:
            continue
        hashes = _filled(batch.column("_hashes"))
        tested = batch.column("_tested").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        for start, stop in _parts(hashes):
            begins, slots, counts = _sparse(hashes.slice(start, stop - start), width)
            n = stop - start
            arrays_of = {"begins": begins.astype("<i8"), "slots": slots.astype("<i4"), "counts": counts.astype("<f4")}
            empty = {"y": b"", "fits": np.zeros(n, np.uint8).tobytes()}
            block = _Block({"n": n, **{k: v.tobytes() for k, v in arrays_of.items()}, **empty})
            score = block.per_document(of_slots) / _norms(block, idf) + intercept
            rows, models = np.nonzero(tested[start:stop].astype(bool))
            kept = batch.select(batch.schema.names[:n_keep]).slice(start, n).take(pa.array(rows))
            found = score[rows, models]
            columns = [*kept.columns, pa.array(models, pa.int32()), pa.array(found), pa.array(found > 0).cast(pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*kept.schema.names, "model", "score", "pred"])
