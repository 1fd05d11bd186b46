"""Random forests on sparse features, all trees grown together level by level.

Rows stand in blocks as sparse vectors of features that are not negative. On each level
a block sends, for every node that is still to be split, the entries of its rows among
the node's candidate features; these are brought together by node, those of a large node by
node and feature, and the best split of each node, by Gini impurity over exact thresholds,
goes to the driver and back to the blocks. A candidate set is an arc of the features in an order that is random per level,
so a row finds its candidates by two searches per tree, however many features there are.
Trees are those of a random forest: rows are drawn with replacement (Poisson weights by a
hash of the row's key), candidates number the square root of the features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import LARGE_ROWS, forget_shuffles, new_path, release
from .term_blocks import term_digests, weighted_entries

ROWS = 1024  # of a block at most
SHARE = 1 << 18  # entries that are looked at together, about, for the best splits
ARC = 40  # bits of a feature's place in the order of a level
DRAWS = np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1)) for k in range(12)])
FEATURE_BLOCK = "n long, ids binary, begins binary, features binary, entries binary"
STATE = f"{FEATURE_BLOCK}, nodes binary"
FOUND = "node int, feature long, at double, left0 double, left1 double, gain double"


@dataclass(frozen=True)
class Level:
    """Nodes of one depth of all trees: the feature they split by, or no child; values
    below `at` go to node `child` of the next level, others to the one after."""

    feature: np.ndarray
    at: np.ndarray
    child: np.ndarray  # -1: a leaf
    share: np.ndarray  # of class 1 in the node


@dataclass(frozen=True)
class Forest:
    trees: int
    levels: tuple[Level, ...] = field(repr=False)

    @property
    def depth(self) -> int:
        return len(self.levels) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _salted(x: np.ndarray, *salts: int) -> np.ndarray:
    for salt in salts:
        x = _mix(x + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    return x


def feature_blocks(weighted: DataFrame, numeric: tuple[str, ...], mark: str) -> DataFrame:
    """Blocks of sparse vectors of `weighted_blocks` whose ids are structs with the fields
    `numeric`; these are features beside the terms."""
    return weighted.drop("_kind").mapInArrow(partial(_feature_blocks, numeric, mark), FEATURE_BLOCK)


def _feature_blocks(numeric: tuple[str, ...], mark: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = term_digests(pa.array([f"\2{name}" for name in numeric], pa.string()))["h"]
    for ids, terms, rows, codes, values in weighted_entries(batches, mark):
        features = term_digests(terms)["h"][codes]
        dense = [np.nan_to_num(np.asarray(ids.field(name), np.float64)) for name in numeric]
        if dense:
            cells = np.stack(dense, axis=1)
            at, which = np.nonzero(cells)
            rows, features = np.concatenate([rows, at]), np.concatenate([features, own[which]])
            values = np.concatenate([values, cells[at, which]])
        order = np.lexsort((features, rows))
        rows, features, values = rows[order], features[order], values[order]
        for low in range(0, len(ids), ROWS):
            n = min(ROWS, len(ids) - low)
            begins = np.searchsorted(rows, np.arange(low, low + n + 1))
            some = slice(begins[0], begins[-1])
            yield _row(
                n=n,
                ids=_packed_struct(ids.slice(low, n)),
                begins=(begins - begins[0]).astype("<i8").tobytes(),
                features=features[some].astype("<u8").tobytes(),
                entries=values[some].astype("<f8").tobytes(),
            )


def _packed_struct(ids: pa.StructArray) -> bytes:
    # Without the gaps and offsets of a slice.
    ids = pa.concat_arrays([ids.take(pa.array(np.arange(len(ids))))])
    batch = pa.RecordBatch.from_arrays([ids], ["x"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _row(**values) -> pa.RecordBatch:
    kinds = [pa.int64() if isinstance(v, int) else pa.binary() for v in values.values()]
    arrays = [pa.array([v], kind) for v, kind in zip(values.values(), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, list(values))


class _Block:
    def __init__(self, batch: pa.RecordBatch, k: int):
        raw = lambda name, kind: np.frombuffer(batch.column(name)[k].as_buffer(), kind)
        self.n = batch.column("n")[k].as_py()
        self.begins, self.features, self.values = raw("begins", "<i8"), raw("features", "<u8"), raw("entries", "<f8")
        self.row = np.repeat(np.arange(self.n), np.diff(self.begins))
        self.raw = {name: batch.column(name)[k].as_py() for name in ("n", "ids", "begins", "features", "entries")}

    @property
    def ids(self) -> pa.StructArray:
        return pa.ipc.open_stream(self.raw["ids"]).read_next_batch().column(0)

    def coded(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct features, key of each entry): keys are in order of rows, then features."""
        names, code = np.unique(self.features, return_inverse=True)
        return names, self.row * (len(names) + 1) + code

    def moved(self, level: Level, nodes: np.ndarray, names: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The nodes of the next level that rows in `nodes` (rows x trees) go to; -1 from leaves."""
        out = np.full(nodes.shape, -1, np.int32)
        row, tree = np.nonzero(nodes >= 0)
        node = nodes[row, tree]
        split = level.child[node] >= 0
        row, tree, node = row[split], tree[split], node[split]
        code = np.searchsorted(names, level.feature)
        known = np.append(names, 0)[np.minimum(code, len(names))] == level.feature
        code = np.where(known & (code < len(names)), code, len(names))  # no entry has the last code
        wanted = row * (len(names) + 1) + code[node]
        place = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        value = np.where(keys[place] == wanted, self.values[place], 0.0) if len(keys) else np.zeros(len(row))
        out[row, tree] = level.child[node] + (value >= level.at[node])
        return out


def _draws(ids: pa.StructArray, trees: int, seed: int) -> np.ndarray:
    """How often each row is drawn for each tree."""
    key = np.asarray(ids.field("key"), np.int64).view(np.uint64)
    u = _salted(key[:, None] + _salted(np.arange(trees, dtype=np.uint64), seed)[None, :], 1)
    return np.searchsorted(DRAWS, (u >> np.uint64(11)) / float(1 << 53)).astype(np.uint8)


def grow(blocks: DataFrame, trees: int, depth: int, seed: int, weights: tuple[float, float]) -> Forest:
    """A forest on `feature_blocks` whose ids have `key`, a number per row, and `y`;
    `weights` are those of a row of class 0 and of class 1."""
    spark = blocks.sparkSession
    state, path = _written(blocks.mapInArrow(partial(_planted, trees, seed), STATE))
    roots = state.mapInArrow(partial(_roots, trees, seed, weights), "part binary")
    totals = sum(np.frombuffer(r.part, "<f8").reshape(trees, 2) for r in roots.toLocalIterator())
    # A few hundredths of the features more or fewer make no other forest.
    n_features = state.mapInArrow(_names, "feature long").agg(F.approx_count_distinct("feature", 0.02)).first()[0]
    sizes = state.agg(F.sum(F.octet_length("features") / 8), F.sum("n")).first()
    per_row = (sizes[0] or 0) / max(sizes[1] or 0, 1)
    wanted = max(1, round(np.sqrt(n_features)))
    arc = min(1 << ARC, max(1, round(wanted / max(n_features, 1) * (1 << ARC))))
    levels: list[Level] = []
    try:
        while True:
            n = len(totals)
            all_of = totals.sum(1)
            share = np.divide(totals[:, 1], all_of, out=np.full(n, 0.5), where=all_of > 0)
            level = Level(np.zeros(n, np.uint64), np.zeros(n), np.full(n, -1, np.int64), share)
            levels.append(level)
            open_nodes = (totals > 0).all(1)
            if len(levels) > depth or not open_nodes.any():
                return Forest(trees, tuple(levels))
            number = len(levels)
            place = _salted(np.arange(n, dtype=np.uint64), seed, number, 2) >> np.uint64(24)
            start = (place.astype(np.float64) / (1 << ARC) * ((1 << ARC) - arc)).astype(np.int64)
            parts = shares(np.where(open_nodes, all_of, 0) * (per_row * arc / (1 << ARC)))
            held = spark.sparkContext.broadcast((open_nodes, start, totals, *parts))
            sent = state.mapInArrow(partial(_candidates, held, arc, seed, number, trees, weights), "part int, entries binary")
            found = sent.groupBy("part").applyInArrow(_splits(held), FOUND).toArrow()
            found = found.take(_first_of_best(found))
            del sent
            forget_shuffles(spark)
            node = np.asarray(found["node"])
            level.feature[node] = np.asarray(found["feature"]).view(np.uint64)
            level.at[node] = np.asarray(found["at"])
            level.child[np.sort(node)] = 2 * np.arange(len(node))
            held.destroy()
            if not len(node):
                return Forest(trees, tuple(levels))
            left = np.zeros((n, 2))
            left[node] = np.stack([np.asarray(found["left0"]), np.asarray(found["left1"])], axis=1)
            split = np.sort(node)
            right = totals[split] - left[split]
            right[right < 1e-9 * all_of[split, None]] = 0  # what rounding left of nothing
            totals = np.stack([left[split], right], axis=1).reshape(-1, 2)
            last = spark.sparkContext.broadcast(level)
            before = path
            state, path = _written(state.mapInArrow(partial(_moved, last, trees), STATE))
            last.destroy()
            release(spark, [before])
    finally:
        release(spark, [path])


def shares(expected: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the entries of each node are looked at, from their expected number: the first
    part and the number of parts, more than one for a node that is more than a share."""
    n_parts = np.maximum(np.ceil(expected / SHARE), 1).astype(np.int32)
    return ((np.cumsum(expected) - expected) // SHARE).astype(np.int32), n_parts


def _first_of_best(found: pa.Table) -> np.ndarray:
    """Rows of the best split of each node, of the splits that its parts found."""
    node, gain = np.asarray(found["node"]), np.asarray(found["gain"])
    order = np.lexsort((np.asarray(found["feature"]).view(np.uint64), -gain, node))
    return order[np.flatnonzero(np.diff(node[order], prepend=-1))]


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    """`df` written and read back, so that no level runs those before it again; its path."""
    path = new_path(df.sparkSession, "forest")
    df.write.options(compression="zstd", **LARGE_ROWS).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _planted(trees: int, seed: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row in the roots of the trees that it is drawn for."""
    for batch in batches:
        for k in range(batch.num_rows):
            block = _Block(batch, k)
            drawn = _draws(block.ids, trees, seed) > 0
            nodes = np.where(drawn, np.arange(trees, dtype="<i4")[None, :], np.int32(-1))
            yield _row(**block.raw, nodes=nodes.astype("<i4").tobytes())


def _weights(block: _Block, trees: int, seed: int, weights: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """(y, weight of each row in each tree)."""
    ids = block.ids
    y = np.asarray(ids.field("y"), np.int64)
    return y, _draws(ids, trees, seed) * np.array(weights)[y][:, None]


def _roots(trees: int, seed: int, weights, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((trees, 2))
    for batch in batches:
        for k in range(batch.num_rows):
            y, weight = _weights(_Block(batch, k), trees, seed, weights)
            total[:, 0] += weight[y == 0].sum(0)
            total[:, 1] += weight[y == 1].sum(0)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column("features"):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.frombuffer(raw.as_buffer(), "<i8")))], ["feature"])


def _nodes(batch: pa.RecordBatch, k: int, trees: int) -> np.ndarray:
    return np.frombuffer(batch.column("nodes")[k].as_buffer(), "<i4").reshape(-1, trees)


def _moved(last, trees: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            block = _Block(batch, k)
            nodes = block.moved(last.value, _nodes(batch, k, trees), *block.coded())
            yield _row(**block.raw, nodes=nodes.astype("<i4").tobytes())


ENTRY = np.dtype([("node", "<i4"), ("feature", "<u8"), ("value", "<f8"), ("w0", "<f4"), ("w1", "<f4")])


def _candidates(held, arc, seed, number, trees, weights, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of each row among the candidates of its nodes, dealt by node, or by node
    and feature."""
    open_nodes, start, _, first_part, n_parts = held.value
    for batch in batches:
        for k in range(batch.num_rows):
            block = _Block(batch, k)
            y, weight = _weights(block, trees, seed, weights)
            nodes = _nodes(batch, k, trees)
            places = (_salted(block.features, seed, number, 3) >> np.uint64(64 - ARC)).astype(np.int64)
            keys = (block.row.astype(np.int64) << ARC) | places
            order = np.argsort(keys)
            keys = keys[order]
            row, tree = np.nonzero((nodes >= 0) & open_nodes[np.maximum(nodes, 0)])
            node = nodes[row, tree]
            low_key = (row << ARC) + start[node]
            low = np.searchsorted(keys, low_key)
            high = np.searchsorted(keys, low_key + arc)
            size = high - low
            entry = order[np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)]
            pair = np.repeat(np.arange(len(row)), size)
            out = np.empty(len(entry), ENTRY)
            out["node"], out["feature"], out["value"] = node[pair], block.features[entry], block.values[entry]
            w, one = weight[row[pair], tree[pair]], y[row[pair]] == 1
            out["w0"], out["w1"] = np.where(one, 0, w), np.where(one, w, 0)
            part = first_part[out["node"]] + _salted(out["feature"], 5) % n_parts[out["node"]].astype(np.uint64)
            part = part.astype(np.int32)
            by_part = np.argsort(part, kind="stable")
            out, part = out[by_part], part[by_part]
            edges = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]
            spans = [(part[a], a, b) for a, b in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p for p, _, _ in spans], pa.int32()),
                    pa.array([out[a:b].tobytes() for _, a, b in spans], pa.binary()),
                ],
                names=["part", "entries"],
            )


def _splits(held) -> Callable[[pa.Table], pa.Table]:
    def splits(table: pa.Table) -> pa.Table:
        return _best(held.value[2], table)

    return splits


def _best(totals: np.ndarray, table: pa.Table) -> pa.Table:
    """The best split of each node among the entries of its candidates, if any gains."""
    rows = np.concatenate([np.frombuffer(x.as_buffer(), ENTRY) for x in table["entries"]])
    rows = rows[np.lexsort((rows["value"], rows["feature"], rows["node"]))]
    node, value = rows["node"], rows["value"]
    first = np.ones(len(rows), bool)
    first[1:] = (node[1:] != node[:-1]) | (rows["feature"][1:] != rows["feature"][:-1])
    starts = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    before = np.zeros(len(rows), np.float64)
    left = []
    for c, name in enumerate(("w0", "w1")):
        w = rows[name].astype(np.float64)
        sums = np.cumsum(w) - w
        whole = np.add.reduceat(w, starts)
        absent = np.maximum(totals[node[starts], c] - whole, 0.0)  # rows without the feature
        absent[absent < 1e-6 * totals[node[starts]].sum(1)] = 0.0
        left.append(sums - sums[starts][group] + absent[group])
    before[1:] = np.where(first[1:], 0.0, value[:-1])
    l0, l1 = left
    t0, t1 = totals[node, 0], totals[node, 1]
    r0, r1 = np.maximum(t0 - l0, 0), np.maximum(t1 - l1, 0)
    some = 1e-6 * (t0 + t1)
    valid = (l0 + l1 > some) & (r0 + r1 > some) & (value > before)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (l0 * l0 + l1 * l1) / (l0 + l1) + (r0 * r0 + r1 * r1) / (r0 + r1)
        gain = np.where(valid, score - (t0 * t0 + t1 * t1) / (t0 + t1), -np.inf)
    order = np.lexsort((-gain, node))
    top = order[np.flatnonzero(np.diff(node[order], prepend=-1))]
    top = top[gain[top] > 1e-9 * (t0[top] + t1[top])]
    at = (before[top] + value[top]) / 2
    at = np.where(at > before[top], at, value[top])
    columns = [node[top], rows["feature"][top].view(np.int64), at, l0[top], l1[top], gain[top]]
    return pa.table([pa.array(c) for c in columns], names=["node", "feature", "at", "left0", "left1", "gain"])


def predicted(blocks: DataFrame, forest: Forest, keep: list, kinds: str, asked: str | None = None) -> DataFrame:
    """`keep`, fields of the ids, and `pred`, 1 or 0: the class with the larger mean share.
    Blocks with no row in which the field `asked` holds, if given, are left out."""
    held = blocks.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for k in range(batch.num_rows):
                block = _Block(batch, k)
                if asked and not pc.any(block.ids.field(asked)).as_py():
                    continue
                names, keys = block.coded()
                nodes = np.broadcast_to(np.arange(model.trees, dtype=np.int32), (block.n, model.trees))
                share = np.zeros(block.n)
                for level in model.levels:
                    leaf = (nodes >= 0) & (level.child[np.maximum(nodes, 0)] < 0)
                    share += np.where(leaf, level.share[np.maximum(nodes, 0)], 0).sum(1)
                    nodes = block.moved(level, nodes, names, keys)
                    if (nodes < 0).all():
                        break
                pred = pa.array(share > 0.5 * model.trees).cast(pa.int32())
                yield pa.RecordBatch.from_arrays([*[block.ids.field(c) for c in keep], pred], [*keep, "pred"])

    return blocks.mapInArrow(run, f"{kinds}, pred int")
