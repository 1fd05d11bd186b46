"""Hard negatives from Hilbert-ordered blocks with zone maps.

Candidates are sorted by label and by their place on a Hilbert curve, and written as
Parquet rows of one block each: some 1,000 vectors of one label, their ids, and a
zone map, the least and the greatest value of every dimension. For an anchor a and
the box of a block, interval arithmetic bounds all inner products from both sides:
each dimension adds between a[i] * low[i] and a[i] * high[i]. An anchor reads a block
only if these bounds meet one of its windows of scores.

Anchors search twice. For their positives the window goes from a floor up: the least
of the best scores in the anchor's own block, its neighbours on the curve. For the
negatives every positive opens a window below its own score, and only blocks of other
labels count. Zone maps are read by themselves, in pages; anchors travel in groups to
the pages and from there to the blocks they want, so what moves is anchors times
blocks wanted, and no task holds more than a page or a block and one group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

CELLS = 1 << 16  # values of a block: 1,024 vectors of 64 dimensions
MOST_ROWS = 1024  # vectors of a block
GROUP = 512  # anchors that ask together
PAGE = 512  # zone maps that are compared with a group at once
CURVE_DIMS, CURVE_BITS = 64, 2  # the curve runs over the dimensions of the greatest spread
LEAST, MOST = -(2**63), 2**63 - 1
EXACT = 2.0**53  # sums below are exact as doubles
SCORABLE = 2.0**62  # squared length up to which every score fits a long

VECTORS = "id long, label int, anchor boolean, size int, vector array<long>, curve binary, row long"
BLOCKS = (
    "part int, seq int, label int, size int, low array<long>, high array<long>, "
    "ids binary, named int, vectors binary, places binary, floors binary"
)
ANCHORS = "part int, seq int, place int, anchor_id long, label int, size int, vector binary, floor long"
GROUPS = "size int, n int, keys binary, labels binary, vectors binary, windows binary"
WANTED = f"b_part int, b_seq int, {GROUPS}"
HITS = "part int, seq int, place int, nth int, id long, score long"
KEY = ["part", "seq", "place"]


def hard_negatives(
    df: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: float = 256.0,
    positives: int = 5,
    negatives: int = 5,
    lowest: int = 80,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x); a score is the integer inner product, higher
    first, ties by smaller id, null ids last. The first `positives` other rows of the
    anchor's label are its positives; of rows of other labels, the first `negatives`
    whose score is at least `lowest` hundredths of the positive's and at most its score
    are returned. A positive of negative score has none.

    Rows with a null label, a null vector or a null or non-finite component take no part,
    nor do vectors too long for scores that fit a long. Vectors of unequal size are
    multiplied over the shorter one's dimensions. Rows that repeat an id are rows of
    their own: each is an anchor, if its id is one. An empty table gives no rows.
    """
    blocks = _blocks_table(df, anchor, id_col, vector_col, label_col, scale, positives)
    pages, n_pages = _zone_pages(blocks)
    around = blocks.filter(F.octet_length("places") > 1)
    around = around.select("part", "seq", "label", "size", "ids", "named", "vectors", "places", "floors")
    anchors = materialize(around.mapInArrow(_anchors, ANCHORS), "negatives-anchors")

    above = anchors.withColumns({"lows": F.array("floor"), "highs": F.array(F.lit(MOST))})
    found = _search(above, blocks, pages, n_pages, True, positives)
    found = materialize(found.withColumnRenamed("rank", "nth_positive").drop("nth"), "negatives-positives")

    hundredth, rest = F.expr("score DIV 100"), F.col("score") % 100
    low = hundredth * lowest + F.ceil(rest * lowest / 100)
    opened = found.filter("score >= 0").groupBy(*KEY).agg(
        F.sort_array(F.collect_list(F.struct("nth_positive", low.alias("low"), F.col("score").alias("high")))).alias("w")
    )
    below = anchors.join(opened, KEY).withColumns(
        {
            "lows": F.col("w.low"),
            "highs": F.col("w.high"),
        }
    )
    hits = _search(below, blocks, pages, n_pages, False, negatives)
    named = anchors.select(*KEY, "anchor_id").join(found, KEY)
    named = named.select(
        *KEY,
        "anchor_id",
        F.col("nth_positive").alias("nth"),
        F.col("id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    return named.join(hits, [*KEY, "nth"]).select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def _blocks_table(
    df: DataFrame, anchor: Column, id_col: str, vector_col: str, label_col: str, scale: float, positives: int
) -> DataFrame:
    """The candidates, all of them, in blocks along the curve."""
    finite = F.forall(vector_col, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    whole = df.filter(df[label_col].isNotNull() & df[vector_col].isNotNull() & finite)
    vector = F.transform(vector_col, lambda x: F.floor(x.cast("double") * F.lit(scale)))
    rows = whole.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("int").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
        vector.alias("vector"),
    ).withColumn("size", F.size("vector"))
    length = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    rows = materialize(rows.filter(length <= SCORABLE), "negatives-vectors")
    spread = rows.select(F.posexplode("vector").alias("dim", "x")).groupBy("dim")
    spread = spread.agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("width"))
    frame = [tuple(r) for r in spread.orderBy(F.desc("width"), "dim").limit(CURVE_DIMS).collect()]
    ordered = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(partial(_on_curve, frame), VECTORS)
    order = ["label", "size", "curve", "id", "row"]
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ordered.mapInArrow(partial(_blocks, positives), BLOCKS), "negatives-blocks")


def _zone_pages(blocks: DataFrame) -> tuple[DataFrame, int]:
    """(page, zones): the zone maps of PAGE consecutive blocks, and the number of pages."""
    counts = blocks.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # As many rows as the sort had partitions.
    offsets = counts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    number = F.col("offset") + F.col("seq")
    zones = blocks.select("part", "seq", "label", "size", "low", "high").join(F.broadcast(offsets), "part")
    zones = zones.withColumn("page", F.floor(number / PAGE).cast("int"))
    pages = zones.groupBy("page").agg(
        F.collect_list(F.struct("part", "seq", "label", "size", "low", "high")).alias("zones")
    )
    return materialize(pages, "negatives-zones"), -(-total // PAGE)


def _search(
    anchors: DataFrame, blocks: DataFrame, pages: DataFrame, n_pages: int, same: bool, first: int
) -> DataFrame:
    """(part, seq, place, nth, rank, id, score): per anchor and window (the nth of `lows`
    and `highs`) the first candidates whose scores lie in it."""
    asking = anchors.select(*KEY, "label", "size", "vector", "lows", "highs").mapInArrow(_groups, GROUPS)
    page = F.explode(F.sequence(F.lit(0), F.lit(max(0, n_pages - 1)))).alias("page")
    wanted = asking.select("*", page).join(pages, "page").mapInArrow(partial(_choose, same), WANTED)
    read = blocks.select(
        F.col("part").alias("b_part"),
        F.col("seq").alias("b_seq"),
        F.col("size").alias("b_size"),
        F.col("vectors").alias("b_vectors"),
        "ids",
        "named",
    )
    hits = wanted.join(read, ["b_part", "b_seq"]).mapInArrow(partial(_score, first), HITS)
    order = Window.partitionBy(*KEY, "nth").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first)


# --- in tasks ---


def packed(values: np.ndarray) -> bytes:
    """Integers in the narrowest width that holds them, after a byte with that width."""
    for width in (1, 2, 4):
        bound = 1 << (8 * width - 1)
        if not values.size or (values.min() >= -bound and values.max() < bound):
            return bytes([width]) + values.astype(f"<i{width}").tobytes()
    return bytes([8]) + values.astype("<i8").tobytes()


def unpacked(raw: bytes, *shape: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[0]}", offset=1).reshape(shape).astype(np.int64)


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Place on the Hilbert curve of each row of cell numbers below 2 ** bits, as bytes
    that sort like it (Skilling's transform from axes)."""
    x = np.ascontiguousarray(cells.T).astype(np.uint32)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = np.uint32(q - 1)
        for i in range(len(x)):
            set_here = (x[i] & q) != 0
            swap = np.where(set_here, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_here, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint32)
    q = top
    while q > 1:
        flip ^= np.where(x[-1] & q, np.uint32(q - 1), 0)
        q >>= 1
    x ^= flip
    planes = [(x >> b) & 1 for b in range(bits - 1, -1, -1)]
    keys = np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)
    return [k.tobytes() for k in keys]


def _on_curve(frame: list[tuple], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    dims = np.array([f[0] for f in frame], np.int64)
    mean, width = (np.array([f[k] for f in frame]) for k in (1, 2))
    width = np.where(width > 0, width, 1)
    for batch in batches:
        vectors = batch.column("vector")
        size = batch.column("size").to_numpy()
        if len(dims) and batch.num_rows:
            begins = np.asarray(vectors.offsets)[:-1].astype(np.int64)
            flat = np.append(vectors.values.to_numpy(zero_copy_only=False), 0)
            at = np.where(dims < size[:, None], begins[:, None] + dims, len(flat) - 1)
            cells = np.digitize((flat[at] - mean) / width, [-0.6745, 0.0, 0.6745])  # quarters of a normal spread
            curve = hilbert_keys(cells, CURVE_BITS)
        else:
            curve = [b""] * batch.num_rows
        columns = [batch.column(c) for c in ("id", "label", "anchor", "size", "vector")]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(curve, pa.binary()), batch.column("row")],
            ["id", "label", "anchor", "size", "vector", "curve", "row"],
        )


def _blocks(positives: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of consecutive rows of one label and size."""
    part, seq = TaskContext.get().partitionId(), 0
    kind, held, n_held = None, [], 0  # rows that wait for their block to fill

    def block() -> dict:
        nonlocal seq, held, n_held
        ids, anchor, vectors = (np.concatenate(x) for x in zip(*held, strict=True))
        most = _most_rows(kind[1])
        rest = (ids[most:], anchor[most:], vectors[most:])
        held, n_held = ([rest], len(rest[0])) if len(rest[0]) else ([], 0)
        ids, anchor, vectors = ids[:most], anchor[:most], vectors[:most]
        missing = np.array([x is None for x in ids])
        number = np.array([0 if x is None else x for x in ids], np.int64)
        order = np.lexsort((number, missing))
        number, anchor, vectors = number[order], anchor[order], vectors[order]
        places = np.flatnonzero(anchor)
        floors = np.full(len(places), LEAST, np.int64)
        if len(ids) > positives and len(places):
            scores = _scores(vectors[places], vectors)
            scores[np.arange(len(places)), places] = LEAST
            floors = np.partition(scores, len(ids) - positives, axis=1)[:, len(ids) - positives]
        row = {
            "part": part,
            "seq": seq,
            "label": kind[0],
            "size": kind[1],
            "low": vectors.min(0),
            "high": vectors.max(0),
            "ids": packed(number),
            "named": int((~missing).sum()),
            "vectors": packed(vectors),
            "places": packed(places),
            "floors": packed(floors),
        }
        seq += 1
        return row

    for batch in batches:
        if not batch.num_rows:
            continue
        label, size = (batch.column(c).to_numpy() for c in ("label", "size"))
        ids = np.array(batch.column("id").to_pylist(), object)
        anchor = batch.column("anchor").to_numpy(zero_copy_only=False)
        starts = np.flatnonzero((np.diff(label, prepend=label[0]) != 0) | (np.diff(size, prepend=size[0]) != 0))
        starts = [0, *starts]
        done = []
        for start, stop in zip(starts, [*starts[1:], len(label)], strict=True):
            here = (int(label[start]), int(size[start]))
            if here != kind and held:
                done.append(block())
            kind = here
            values = batch.column("vector").slice(start, stop - start).flatten()
            vectors = values.to_numpy(zero_copy_only=False).reshape(stop - start, here[1])
            held.append((ids[start:stop], anchor[start:stop], vectors))
            n_held += stop - start
            while n_held >= _most_rows(here[1]):
                done.append(block())
        yield _batch(BLOCKS, done)
    if held:
        yield _batch(BLOCKS, [block()])


def _most_rows(size: int) -> int:
    return max(1, min(MOST_ROWS, CELLS // max(size, 1)))


KINDS = {
    "int": pa.int32(),
    "long": pa.int64(),
    "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()),
}


def _batch(schema: str, rows: list[dict]) -> pa.RecordBatch:
    columns = [c.split() for c in schema.split(", ")]
    arrays = [pa.array([r[name] for r in rows], KINDS[kind]) for name, kind in columns]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in columns])


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows, exact; of vectors of unequal size, over the shorter."""
    size = min(a.shape[1], b.shape[1])
    a, b = a[:, :size], b[:, :size]
    if size and size * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) >= EXACT:
        return a @ b.T
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            places = unpacked(r["places"], -1)
            floors, ids = unpacked(r["floors"], -1), unpacked(r["ids"], -1)
            vectors = unpacked(r["vectors"], -1, r["size"]) if r["size"] else np.zeros((len(ids), 0), np.int64)
            for place, floor in zip(places.tolist(), floors.tolist(), strict=True):
                found = {"place": place, "floor": floor, "vector": packed(vectors[place])}
                found["anchor_id"] = int(ids[place]) if place < r["named"] else None
                rows.append({k: r[k] for k in ("part", "seq", "label", "size")} | found)
        yield _batch(ANCHORS, rows)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to GROUP anchors of one size as a row, with as many windows each; unused ones are empty."""
    for batch in batches:
        by_size: dict[int, list[dict]] = {}
        for r in batch.to_pylist():
            by_size.setdefault(r["size"], []).append(r)
        rows = []
        for size, members in by_size.items():
            for start in range(0, len(members), GROUP):
                some = members[start : start + GROUP]
                windows = np.tile(np.array([1, 0], np.int64), (len(some), max(len(r["lows"]) for r in some), 1))
                for k, r in enumerate(some):
                    windows[k, : len(r["lows"]), 0], windows[k, : len(r["highs"]), 1] = r["lows"], r["highs"]
                vectors = np.array([unpacked(r["vector"], size) for r in some], np.int64).reshape(len(some), size)
                keys = np.array([[r[c] for c in KEY] for r in some], np.int64)
                rows.append(_group(size, keys, np.array([r["label"] for r in some]), vectors, windows))
        yield _batch(GROUPS, rows)


def _group(size: int, keys: np.ndarray, labels: np.ndarray, vectors: np.ndarray, windows: np.ndarray) -> dict:
    names = ("keys", "labels", "vectors", "windows")
    arrays = {name: packed(x) for name, x in zip(names, (keys, labels, vectors, windows), strict=True)}
    return {"size": size, "n": len(keys), **arrays}


def _members(r: dict) -> tuple[np.ndarray, ...]:
    n = r["n"]
    windows = unpacked(r["windows"], -1)
    return (
        unpacked(r["keys"], n, 3),
        unpacked(r["labels"], n),
        unpacked(r["vectors"], n, r["size"]),
        windows.reshape(n, -1, 2),
    )


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with any vector of each box."""
    above, below = np.maximum(anchors, 0).astype(np.float64), np.minimum(anchors, 0).astype(np.float64)
    low, high = low.T.astype(np.float64), high.T.astype(np.float64)
    least, most = above @ low + below @ high, above @ high + below @ low
    # Rounding of doubles beyond 2 ** 53, so that no block is left out by it.
    slack = (above - below) @ np.maximum(np.abs(low), np.abs(high)) * 1e-12
    return least - slack, most + slack


def _choose(same: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block of a page, the anchors of a group that want to read it."""
    for batch in batches:
        for k in range(batch.num_rows):
            r = batch.slice(k, 1).to_pylist()[0]
            keys, labels, vectors, windows = _members(r)
            by_size: dict[int, list[dict]] = {}
            for zone in r["zones"]:
                by_size.setdefault(zone["size"], []).append(zone)
            rows = []
            for size, zones in by_size.items():
                both = min(size, r["size"])
                low, high = (np.array([z[c] for z in zones], np.int64)[:, :both] for c in ("low", "high"))
                least, most = bounds(vectors[:, :both], low, high)
                alike = labels[:, None] == np.array([z["label"] for z in zones])
                meets = np.zeros(least.shape, bool)
                for w in range(windows.shape[1]):
                    begin, end = windows[:, w, :1], windows[:, w, 1:]
                    meets |= (begin <= end) & (most >= begin) & (least <= end)
                meets &= alike if same else ~alike
                for z in np.flatnonzero(meets.any(0)):
                    rows_in = meets[:, z]
                    members = (keys[rows_in], labels[rows_in], vectors[rows_in], windows[rows_in])
                    rows.append({"b_part": zones[z]["part"], "b_seq": zones[z]["seq"]} | _group(r["size"], *members))
            yield _batch(WANTED, rows)


def _score(first: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first candidates of a block in each window of each anchor that reads it."""
    names = [c.split()[0] for c in HITS.split(", ")]
    for batch in batches:
        for k in range(batch.num_rows):
            r = batch.slice(k, 1).to_pylist()[0]
            keys, _, vectors, windows = _members(r)
            ids = unpacked(r["ids"], -1)
            scores = _scores(vectors, unpacked(r["b_vectors"], len(ids), r["b_size"]))
            own = np.flatnonzero((keys[:, 0] == r["b_part"]) & (keys[:, 1] == r["b_seq"]))
            others = np.ones(scores.shape, bool)
            others[own, keys[own, 2]] = False
            found = []
            for w in range(windows.shape[1]):
                inside = others & (scores >= windows[:, w, :1]) & (scores <= windows[:, w, 1:])
                rows, places = _first_of(scores, inside, first)
                found.append((rows, np.full(len(rows), w + 1), places, scores[rows, places]))
            rows, nth, places, score = (np.concatenate(x) for x in zip(*found, strict=True))
            columns = [*keys[rows].T, nth]
            arrays = [pa.array(c, pa.int32()) for c in columns]
            arrays += [pa.array(ids[places], mask=places >= r["named"]), pa.array(score)]
            yield pa.RecordBatch.from_arrays(arrays, names)


def _first_of(scores: np.ndarray, inside: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the greatest `first` scores of each row that are inside, ties by
    the smaller column: a block's rows are in the order of their ids."""
    if scores.shape[1] > first:
        held = np.where(inside, scores, LEAST)
        least = np.partition(held, scores.shape[1] - first, axis=1)[:, -first:].min(1)
        inside = inside & (held >= least[:, None])
    rows, places = np.nonzero(inside)
    order = np.lexsort((places, -scores[rows, places], rows))
    rows, places = rows[order], places[order]
    nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[nth < first], places[nth < first]
