"""Second-order boosting of regression trees on histograms: one task for a small table, else tasks that exchange sums, or a job a level over cached blocks."""

from __future__ import annotations

import math
import os
import shutil
import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, BarrierTaskContext, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

BINS = 256
CELL_BITS = 18
ONE_TASK_ROWS = 500_000
TASK_ROWS = 250_000
MOST_TASKS = 64
HELD_ROWS = 2_000_000  # rows that one of several tasks keeps in memory
MOST_PEERS = 32
WAIT_S = 600  # how long a task waits for the sums of another
BLOCK_ROWS = 1 << 18
CHUNK_ROWS = 1 << 13  # rows worked on at a time: arrays of this length stay in the cache and are not mapped anew
BYTE_ROWS = 1 << 16  # the same for arrays of bytes
BUNDLE_CELLS = 1 << 10
MOST_COMPARED = 32  # splits of a level that are compared one by one
MOST_CELLS = 1 << 20  # cells of the histograms that are measured at a time
REBASE_TREES = 50
LEAST_HESSIAN = 1.0
LEAST_GAIN = 1e-6

_NODES = "tree int, node int, feature int, threshold double, value double, g double, h double"
_BLOCK = "bins binary, y binary, w binary, key binary, margin binary"


@dataclass(frozen=True)
class Trees:
    """Fitted trees as arrays [tree, node]: node i has children 2i+1 (x <= threshold) and 2i+2; a leaf has feature -1.

    ``value`` of a leaf is what it adds to the log-odds ``base``; ``g`` and ``h`` are the sums of gradients and hessians it was
    fitted on. ``losses`` are mean weighted log losses before each tree and after the last.
    """

    base: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    g: np.ndarray
    h: np.ndarray
    losses: np.ndarray

    @cached_property
    def _complete(self) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Trees with leaves on the last level only: distinct thresholds of each feature, and of each tree the feature of its inner nodes,
        the number of their threshold, and the values of its leaves. What ends above the last level goes to the left all the way down."""
        inner = (1 << self.depth) - 1
        feature, value = self.feature.astype(np.int64), self.value.copy()
        for node in range(inner):
            ends = feature[:, node] < 0
            for child in (2 * node + 1, 2 * node + 2):
                value[ends, child] = value[ends, node]
                feature[ends, child] = -1
        feature, threshold = feature[:, :inner], self.threshold[:, :inner]
        cuts = [np.unique(threshold[feature == f]) for f in range(max(0, feature.max(initial=-1)) + 1)]
        number = np.zeros(feature.shape, np.int64)
        for f, c in enumerate(cuts):
            number[feature == f] = np.searchsorted(c, threshold[feature == f])
        number[feature < 0] = np.iinfo(np.uint16).max
        return cuts, np.maximum(feature, 0), number, value[:, inner : 2 * inner + 1]

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1 for each row."""
        cuts, *_ = self._complete
        few = self.depth <= 6 and max(map(len, cuts)) < np.iinfo(np.uint16).max
        out = np.full(len(x), self.base)
        for low in range(0, len(x), BYTE_ROWS):
            part = slice(low, low + BYTE_ROWS)
            out[part] += self._by_ranks(x[part]) if few else self._by_steps(x[part])
        return out

    def _by_ranks(self, x: np.ndarray) -> np.ndarray:
        """A value becomes the number of thresholds below it once; all inner nodes are compared, and a level's answer is chosen by those above."""
        cuts, features, numbers, values = self._complete
        kind = np.uint8 if max(map(len, cuts)) < 256 else np.uint16
        ranks = []
        for f, c in enumerate(cuts):
            rank = np.empty(len(x), kind)
            for low in range(0, len(x), CHUNK_ROWS):
                own = x[low : low + CHUNK_ROWS, f]
                rank[low : low + CHUNK_ROWS] = np.where(np.isnan(own), 0, np.searchsorted(c, own))  # without a value nothing is beyond
            ranks.append(rank)
        most, out = np.iinfo(kind).max, np.zeros(len(x))
        for feature, number, value in zip(features, np.minimum(numbers, most).tolist(), values):
            beyond = [(ranks[f] > k).view(np.uint8) for f, k in zip(feature.tolist(), number)]
            at, answers = np.zeros(len(x), np.uint8), []
            for level in range(self.depth):
                chosen = beyond[(1 << level) - 1 : (2 << level) - 1]
                for answer in reversed(answers):
                    chosen = [low ^ ((low ^ high) & answer) for low, high in zip(chosen[::2], chosen[1::2])]
                answers.append(chosen[0])
                at += at
                at |= chosen[0]
            for low in range(0, len(x), CHUNK_ROWS):
                out[low : low + CHUNK_ROWS] += value.take(at[low : low + CHUNK_ROWS])
        return out

    def _by_steps(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        flat, first = np.ascontiguousarray(x, np.float64).ravel(), np.arange(len(x)) * (x.shape[1] if x.ndim > 1 else 1)
        inner = (1 << self.depth) - 1
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            # a leaf above the last level hands its value down to both sides
            feature, value = feature.astype(np.int64), value.copy()
            for node in np.flatnonzero(feature[:inner] < 0):
                feature[node] = 0
                value[2 * node + 1] = value[2 * node + 2] = value[node]
                feature[2 * node + 1] = feature[2 * node + 2] = -1
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                right = flat.take(first + feature.take(at)) > threshold.take(at)
                at *= 2
                at += 1
                at += right
            out += value.take(at)
        return out

    def probability(self, features: Column) -> Column:
        model, _ = self, self._complete  # the arrays go along with the function, some hundred kB

        @F.arrow_udf("double")
        def probability(x: pa.Array) -> pa.Array:
            rows = np.asarray(x.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(x), -1 if len(x) else 0)
            return pa.array(1.0 / (1.0 + np.exp(-model.margin(rows))))

        return probability(features)


def _cell(x: np.ndarray) -> np.ndarray:
    """Cells of about 1.6 percent width in the order of the values: the leading bits of a double."""
    bits = np.ascontiguousarray(x, np.float64).view(np.int64)
    return np.where(bits < 0, ~bits ^ np.int64(-(1 << 63)), bits) >> (64 - CELL_BITS)


def _rows(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return np.asarray(batch.column("features").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(batch), d)


def thresholds(df: DataFrame, d: int, bins: int = BINS) -> list[np.ndarray]:
    """At most ``bins`` - 1 places to split each feature, between cells of about equal numbers of rows.

    Rows are counted by feature and cell, a fixed division of the numbers, so the result does not depend on the
    partitioning; the driver gets a few thousand cells a feature. A feature with few values can be split between any two.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch, d)
            for j in range(d if len(x) else 0):
                order = np.argsort(x[:, j])
                value = x[order, j] + 0.0
                cell, at, n = np.unique(_cell(value), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_pydict({"feature": np.full(len(cell), j), "cell": cell, "n": n, "low": value[at], "high": value[at + n - 1]})

    found = df.select("features").mapInArrow(count, "feature long, cell long, n long, low double, high double")
    cells = found.groupBy("feature", "cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
    out = []
    for j in range(d):
        own = cells[cells["feature"] == j].sort_values("cell")
        low, high, n = own["low"].to_numpy(), own["high"].to_numpy(), own["n"].to_numpy()
        between = (high[:-1] + low[1:]) / 2
        between = np.where(between >= low[1:], high[:-1], between)
        if len(between) >= bins:
            wanted = np.arange(1, bins) * n.sum() / bins
            between = between[np.unique(np.minimum(np.searchsorted(np.cumsum(n), wanted), len(between) - 1))]
        out.append(between)
    return out


def _drawn(keys: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    """Which rows a tree draws: those whose hash of key and tree is in the lowest ``share`` of all numbers."""
    h = keys + np.uint64((seed * 0x9E3779B97F4A7C15 + tree * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(31)
    return h < np.uint64(min(int(share * 2.0**64), (1 << 64) - 1))


@dataclass(frozen=True)
class _Plan:
    """What all trees of a fit have in common."""

    cuts: list[np.ndarray]
    base: float
    scale: float
    trees: int
    depth: int
    rate: float
    share: float
    penalty: float
    seed: int

    @cached_property
    def bundles(self) -> list[list[int]]:
        """Features that are counted together: as many as have at most ``BUNDLE_CELLS`` combinations of bins, so few-valued ones cost little."""
        out: list[list[int]] = []
        sizes = [len(c) + 1 for c in self.cuts]
        for f in sorted(range(len(sizes)), key=lambda f: -sizes[f]):
            fits = (b for b in out if math.prod(sizes[k] for k in [*b, f]) <= BUNDLE_CELLS)
            own = next(fits, None)
            out.append([f]) if own is None else own.append(f)
        return out

    @property
    def width(self) -> int:
        return max(map(len, self.cuts)) + 1

    @property
    def size(self) -> int:
        return (1 << (self.depth + 1)) - 1

    def columns(self, tree: int) -> np.ndarray:
        d = len(self.cuts)
        return np.sort(np.random.default_rng([self.seed, tree]).choice(d, max(1, int(self.share * d)), replace=False))


class _Rows:
    """Some rows: bins [feature, row], label, weight, key and log-odds so far; while a tree grows also gradients and the node of each row."""

    def __init__(self, bins: np.ndarray, y: np.ndarray, weight: np.ndarray, keys: np.ndarray, margin: np.ndarray, depth: int):
        self.bins, self.y, self.weight, self.keys, self.margin = bins, y, weight, keys, margin
        self.node_type = np.uint8 if depth < 8 else np.uint16 if depth < 16 else np.int64
        self.g, self.h, self.here, self.codes = np.empty(len(y)), np.empty(len(y)), np.empty(len(y), np.intp), None
        self.back()

    def back(self) -> None:
        """All rows at the root."""
        self.at, self.level = np.zeros(len(self.y), self.node_type), 0

    def _parts(self, size: int = CHUNK_ROWS) -> Iterator[slice]:
        return (slice(low, low + size) for low in range(0, len(self.y), size))

    def start(self, tree: int, plan: _Plan) -> np.ndarray:
        """Gradients for a tree; the summed loss before it and the weight, both in whole units."""
        total = np.zeros(2)
        for s in self._parts():
            margin, y, weight = np.clip(self.margin[s], -700.0, 700.0), self.y[s], self.weight[s] * plan.scale
            odds = np.exp(-margin)
            odds += 1.0
            p = 1.0 / odds
            loss = np.log(odds) + margin * (y <= 0)
            total += np.rint(loss * weight).sum(), np.rint(weight).sum()
            weight *= _drawn(self.keys[s], tree, plan.seed, plan.share)
            np.rint((p - y) * weight, out=self.g[s])
            np.rint(np.maximum(p * (1.0 - p), 1e-16) * weight, out=self.h[s])
        self.back()
        return total

    def descend(self, feature: np.ndarray, bin_: np.ndarray) -> None:
        """One level down, for the rows whose node is split."""
        leaf, ids = feature < 0, np.arange(len(feature))
        following = np.where(leaf, ids, 2 * ids + 1).clip(0, len(feature) - 1).astype(self.node_type)
        own = slice((1 << self.level) - 1, (2 << self.level) - 1)
        split = own.start + np.flatnonzero(~leaf[own])
        self.level += 1
        if len(split) <= MOST_COMPARED:
            for s in self._parts(BYTE_ROWS):
                at = self.at[s]
                below = following.take(at)
                for i in split.tolist():
                    beyond = self.bins[feature[i], s] > self.bins.dtype.type(bin_[i])
                    beyond &= at == i
                    below += beyond.view(np.uint8)
                self.at[s] = below
            return
        first, limit = np.where(leaf, 0, feature) * len(self.y), np.where(leaf, np.iinfo(self.bins.dtype).max, bin_)
        for s in self._parts():
            at = self.at[s].astype(np.int64)
            beyond = self.bins.ravel().take(first.take(at) + np.arange(s.start, s.start + len(at))) > limit.take(at)
            self.at[s] = following.take(at) + beyond

    def _codes(self, plan: _Plan) -> list[np.ndarray]:
        """One number a row for each bundle: the bins of its features, the first of them fastest."""
        if self.codes is None:
            self.codes = []
            for bundle in plan.bundles:
                if len(bundle) == 1:
                    self.codes.append(self.bins[bundle[0]])
                    continue
                code = np.zeros(len(self.y), np.uint16)
                for f in reversed(bundle):
                    code *= np.uint16(len(plan.cuts[f]) + 1)
                    code += self.bins[f]
                self.codes.append(code)
        return self.codes

    def _select(self, wanted: np.ndarray) -> int:
        """Number of the drawn rows at nodes that are wanted; their places are the first of ``here``."""
        n = 0
        for s in self._parts():
            found = np.flatnonzero(wanted.take(self.at[s]) & (self.h[s] != 0))
            self.here[n : n + len(found)] = found + s.start
            n += len(found)
        return n

    def histogram(self, nodes: np.ndarray, columns: np.ndarray, plan: _Plan) -> np.ndarray:
        """[gradient or hessian, node, column, bin] sums over the rows in the given nodes."""
        wanted = {int(f): k for k, f in enumerate(columns)}
        counted = [(bundle, codes) for bundle, codes in zip(plan.bundles, self._codes(plan)) if any(f in wanted for f in bundle)]
        sizes = [math.prod(len(plan.cuts[f]) + 1 for f in bundle) for bundle, _ in counted]
        sums = [np.zeros((2, len(nodes) * size)) for size in sizes]
        place_of = np.full(plan.size, -1)
        place_of[nodes] = np.arange(len(nodes))
        most = self._select(place_of >= 0) if self.level else len(self.y)
        step = max(CHUNK_ROWS, len(nodes) * max(sizes, default=0))  # a count clears as many cells
        for low in range(0, most, step):
            here = self.here[low : min(low + step, most)] if self.level else slice(low, low + step)
            g, h = (x.take(here) if self.level else x[here] for x in (self.g, self.h))
            place = place_of.take(self.at.take(here)) if self.level else None
            for (_, codes), size, out in zip(counted, sizes, sums):
                cell = codes[here].astype(np.intp) if place is None else place * size + codes.take(here)
                out[0] += np.bincount(cell, g, out.shape[1])
                out[1] += np.bincount(cell, h, out.shape[1])
        found = np.zeros((2, len(nodes), len(columns), plan.width))
        for (bundle, _), out in zip(counted, sums):
            shape = [len(plan.cuts[f]) + 1 for f in reversed(bundle)]
            cells = out.reshape(2, len(nodes), *shape)
            for axis, f in enumerate(reversed(bundle)):
                if f in wanted:
                    others = tuple(2 + a for a in range(len(shape)) if a != axis)
                    found[:, :, wanted[f], : shape[axis]] = cells.sum(axis=others)
        return found

    def finish(self, value: np.ndarray) -> None:
        for s in self._parts():
            self.margin[s] += value.take(self.at[s])


Node = dict[str, np.ndarray]
Measure = Callable[[Node, int, np.ndarray], np.ndarray]


def _grow(tree: int, plan: _Plan, measure: Measure) -> Node:
    """The node arrays of one tree. ``measure`` gives the histograms of nodes of a level, summed over all rows in whole units.

    Of two children only the one with the smaller hessian is measured; the other is what is left of their parent. All sums are whole
    numbers below 2**53, so neither order nor difference changes them.
    """
    columns, width, size = plan.columns(tree), plan.width, plan.size
    may_split = np.arange(width)[None, :] < np.array([len(c) for c in plan.cuts])[columns][:, None]
    node = {"feature": np.full(size, -1), "bin": np.zeros(size, np.int64), "threshold": np.zeros(size), "g": np.zeros(size), "h": np.zeros(size)}
    most = max(1, MOST_CELLS // (len(columns) * width))
    active, parents = np.array([0]), {}
    for level in range(plan.depth):
        known: dict[int, np.ndarray] = {}
        following = []
        pairs = active.reshape(-1, 2) if level else active.reshape(1, 1)
        for low in range(0, len(pairs), most):
            part = pairs[low : low + most]
            first = part[:, 0] if not level else np.where(node["h"][part[:, 0]] <= node["h"][part[:, 1]], part[:, 0], part[:, 1])
            for i, hist in zip(first.tolist(), measure(node, level, first).transpose(1, 0, 2, 3)):
                both = [(i, hist)]
                if level:
                    both.append((i + 1 if i % 2 else i - 1, parents.pop((i - 1) // 2) - hist))
                for k, whole in sorted(both, key=lambda b: b[0]):
                    if _split(node, k, whole / plan.scale, plan, columns, may_split):
                        following += [2 * k + 1, 2 * k + 2]
                        if level + 1 < plan.depth:
                            known[k] = whole
        if not following:
            break
        active, parents = np.array(following), known
    node["value"] = np.where(node["feature"] < 0, -plan.rate * node["g"] / (node["h"] + plan.penalty), 0.0)
    return node


def _split(node: Node, i: int, hist: np.ndarray, plan: _Plan, columns: np.ndarray, may_split: np.ndarray) -> bool:
    """Enter the best split of a node with the histogram [gradient or hessian, column, bin], if it gains anything."""
    left = np.cumsum(hist, axis=2)
    all_ = left[:, :, -1:]
    right = all_ - left
    if not i:
        node["g"][0], node["h"][0] = all_[:, 0, 0]
    gain = _score(left, plan.penalty) + _score(right, plan.penalty) - _score(all_, plan.penalty)
    gain[~(may_split & (left[1] >= LEAST_HESSIAN) & (right[1] >= LEAST_HESSIAN))] = -np.inf
    column, cut = divmod(int(gain.argmax()), plan.width)
    if not gain[column, cut] > LEAST_GAIN:
        return False
    f = columns[column]
    node["feature"][i], node["bin"][i], node["threshold"][i] = f, cut, plan.cuts[f][cut]
    for name, lower, upper in zip("gh", left[:, column, cut], right[:, column, cut]):
        node[name][2 * i + 1], node[name][2 * i + 2] = lower, upper
    return True


def _score(sums: np.ndarray, penalty: float) -> np.ndarray:
    return sums[0] ** 2 / (sums[1] + penalty)


Sum = Callable[[np.ndarray], np.ndarray]


def _boost_here(rows: _Rows, plan: _Plan, add: Sum = lambda own: own) -> Iterator[tuple[int, Node, float]]:
    """(number, node arrays, mean loss before it) of each tree over rows in memory; after the last once more for its loss.

    ``add`` gives the sum of an array over all tasks that share the rows; every task then takes the same decisions.
    """
    for tree in range(plan.trees + 1):
        own, sums = rows.start(tree, plan), np.zeros(2)
        if tree == plan.trees:
            sums = add(own)
            yield tree, {}, sums[0] / max(sums[1], 1.0)
            return

        def measure(node: Node, level: int, nodes: np.ndarray, tree=tree, own=own, sums=sums) -> np.ndarray:
            while level > rows.level:
                rows.descend(node["feature"], node["bin"])
            found = rows.histogram(nodes, plan.columns(tree), plan)
            total = add(np.concatenate([found.ravel(), [] if level else own]))
            if not level:
                sums[:], total = total[-2:], total[:-2]
            return total.reshape(found.shape)

        node = _grow(tree, plan, measure)
        while rows.level < plan.depth:
            rows.descend(node["feature"], node["bin"])
        rows.finish(node["value"])
        yield tree, node, sums[0] / max(sums[1], 1.0)


class _Peers:
    """The tasks of a barrier stage, which add up arrays through files of a folder that all can reach.

    Spark's own exchange between such tasks takes a second, a job takes a tenth; a tree needs one for each level. A file gets its name when it
    is whole. As a task writes its next array only when it has read all of the last ones, its file before that is of no more use.
    """

    def __init__(self, folder: str):
        task = BarrierTaskContext.get()
        names = task.allGather(uuid.uuid4().hex)  # of this attempt: one that was given up has other files
        self.rank, self.size, self.step, self.base = task.partitionId(), len(names), 0, f"{folder}/{names[0]}"

    def _file(self, step: int, rank: int) -> str:
        return f"{self.base}-{step}-{rank}"

    def add(self, own: np.ndarray) -> np.ndarray:
        path = self._file(self.step, self.rank)
        with open(f"{path}.part", "wb") as file:
            file.write(own.tobytes())
        os.rename(f"{path}.part", path)
        total, since = own.copy(), time.monotonic()
        for rank in range(self.size):
            pause = 0.0002
            while rank != self.rank:
                try:
                    with open(self._file(self.step, rank), "rb") as file:
                        total += np.frombuffer(file.read())
                    break
                except FileNotFoundError:
                    if time.monotonic() - since > WAIT_S:
                        raise TimeoutError(f"task {rank} gave no sums for {WAIT_S} s") from None
                    time.sleep(pause)
                    pause = min(2 * pause, 0.02)
        if self.step:
            os.remove(self._file(self.step - 1, self.rank))
        self.step += 1
        return total


def _shared_folder(spark: SparkSession) -> str | None:
    """A new folder among the scratch tables, if tasks can open it as a plain path; else none."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "trees"))
    store = path.getFileSystem(sc._jsc.hadoopConfiguration())
    where = store.makeQualified(path).toUri()
    return where.getPath() if where.getScheme() == "file" and store.mkdirs(path) else None


def _may_exchange(spark: SparkSession, rows: int, tasks: int) -> bool:
    """Whether so many tasks can run at a time and hold the rows."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.dynamicAllocation.enabled", "false") == "true"
    return not given and 1 < tasks <= min(MOST_PEERS, sc.defaultParallelism) and rows <= tasks * HELD_ROWS


def _advance(nodes: list[Node], depth: int, block: tuple) -> tuple:
    """The block after some more trees."""
    rows = _Rows(*block[:4], block[4].copy(), depth)  # what is cached may not be written
    for node in nodes:
        rows.back()
        for _ in range(depth):
            rows.descend(node["feature"], node["bin"])
        rows.finish(node["value"])
    return (*block[:4], rows.margin)


def _count(tree: int, plan: _Plan, node: Node, level: int, nodes: np.ndarray, blocks: Iterator[tuple]) -> Iterator[bytes]:
    """Histograms and, for a root, losses over the blocks of a task. Gradients and nodes are worked out again: cheaper than keeping them."""
    total = None
    for block in blocks:
        rows = _Rows(*block, plan.depth)
        lost = rows.start(tree, plan)
        for _ in range(level):
            rows.descend(node["feature"], node["bin"])
        found = [] if tree == plan.trees else [rows.histogram(nodes, plan.columns(tree), plan).ravel()]
        found = np.concatenate([*found, [] if level else lost])
        total = found if total is None else total + found
    if total is not None:
        yield zlib.compress(total.tobytes(), 1)


def _boost_apart(blocks: RDD, plan: _Plan) -> Iterator[tuple[int, Node, float]]:
    """The same over cached blocks, a job for each level of a tree; the driver adds the tasks' histograms and takes the decisions.

    Blocks with the log-odds after a tree are cached in the first job of the next one. A lost block is computed again from the ones
    before; every ``REBASE_TREES`` trees from the first blocks and all trees, so that a lineage stays short.
    """
    blocks.persist(StorageLevel.MEMORY_AND_DISK)
    state, nodes = blocks, []
    for tree in range(plan.trees + 1):
        older = None
        if tree:
            older, fresh = state, tree % REBASE_TREES == 0
            state = (blocks if fresh else state).map(partial(_advance, nodes if fresh else nodes[-1:], plan.depth)).persist(StorageLevel.MEMORY_AND_DISK)
        sums = np.zeros(2)

        def measure(node: Node, level: int, wanted: np.ndarray, tree=tree, state=state) -> np.ndarray:
            found = state.mapPartitions(partial(_count, tree, plan, node, level, wanted)).collect()
            total = sum(np.frombuffer(zlib.decompress(f)) for f in found)
            if not level:
                sums[:], total = total[-2:], total[:-2]
            return total.reshape(2, len(wanted), -1, plan.width) if len(wanted) else total

        if tree == plan.trees:
            measure({}, 0, np.zeros(0, np.int64))
        else:
            nodes.append(_grow(tree, plan, measure))
        if older is not None and older is not blocks:
            older.unpersist()
        yield tree, nodes[-1] if tree < plan.trees else {}, sums[0] / max(sums[1], 1.0)
    if state is not blocks:
        state.unpersist()
    blocks.unpersist()


def _table(tree: int, node: Node, loss: float) -> dict[str, pa.Array]:
    """The used nodes of a tree, and one (-1) with its loss."""
    used = np.flatnonzero((node["feature"] >= 0) | (node["h"] > 0)) if node else np.zeros(0, np.int64)
    last = {"feature": -1, "value": loss}
    columns = {c: np.append(node[c][used] if node else [], [last.get(c, 0)]) for c in ("feature", "threshold", "value", "g", "h")}
    whole = {"tree": np.full(len(used) + 1, tree), "node": np.append(used, -1), "feature": columns.pop("feature")}
    return {**{k: pa.array(c.astype(np.int32)) for k, c in whole.items()}, **{k: pa.array(c.astype(np.float64)) for k, c in columns.items()}}


def _packed(block: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part.tobytes()], pa.binary()) for part in block], ["bins", "y", "w", "key", "margin"])


def _unpacked(d: int, kind: type, row) -> tuple:
    y, weights, margin = (np.frombuffer(row[c]) for c in ("y", "w", "margin"))
    return np.frombuffer(row["bins"], kind).reshape(d, len(y)), y, weights, np.frombuffer(row["key"], np.uint64), margin


def _limbs(x: Column, name: str) -> list[Column]:
    """Sums of the whole part of a number and of two times 30 bits below it: the same in any order, for up to 2**33 rows."""
    whole = F.floor(x)
    below = (x - whole) * 2.0**30
    parts = (whole, F.floor(below), F.rint((below - F.floor(below)) * 2.0**30).cast("bigint"))
    return [F.sum(part).alias(f"{name}{k}") for k, part in enumerate(parts)]


def fit_trees(df: DataFrame, d: int, label: str = "y", weight: str | None = None, key: str = "row_id", seed: int = 42, trees: int = 200, depth: int = 5,
              rate: float = 0.08, share: float = 0.85, penalty: float = 1.0, bins: int = BINS, tasks: int | None = None,
              cuts: list[np.ndarray] | None = None, exchange: bool | None = None) -> Trees:
    """Boosted trees for the log loss: leaves are -rate G / (H + penalty), splits maximise the gain of G^2 / (H + penalty).

    Each tree draws ``share`` of the rows (by a hash of ``key``, or of features and label where there is no such
    column) and of the features. Features are cut into at most ``bins`` bins once; a row is its bins (one or two bytes a feature), label,
    weight, key and log-odds. Gradients are rounded to whole multiples of a unit chosen so that sums of all rows are exact; so the model
    is the same for any partitioning.

    Up to half a million rows are fitted in one task. Larger tables are spread over tasks (``tasks`` sets their number) in one of two ways. Where
    as many tasks run at a time, hold their rows and open the scratch folder as a path, they are one barrier stage and exchange
    histograms through small files (:class:`_Peers`); if one fails, Spark starts the stage again. Otherwise, or with ``exchange`` False,
    rows are cached as blocks and every level of a tree is a job over them: tasks return histograms of at most ``MOST_CELLS`` cells, never
    rows, which the driver adds to choose the splits, and a lost task is repeated on its own.

    ``cuts`` are the :func:`thresholds` of the same rows where they are known already. A row without label or with a weight that is
    null or not positive takes no part.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    row_key = F.xxhash64(key) if key in df.columns else F.xxhash64("features", label)
    rows = df.select("features", F.col(label).cast("double").alias("y"), w.alias("w"), row_key.alias("key")).filter("y is not null and w > 0")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("w"), *_limbs(F.col("w"), "all"), *_limbs(F.col("w") * F.col("y"), "ones")).first()
    cuts = thresholds(rows, d, bins) if cuts is None else cuts
    whole, ones = (sum(facts[f"{name}{k}"] / 2.0 ** (30 * k) for k in range(3)) for name in ("all", "ones"))
    mean = min(max(ones / whole, 1e-6), 1 - 1e-6)
    base = math.log(mean / (1 - mean))
    # a row's summand is at most 64 w (its loss): all rows together stay below 2**52
    scale = 2.0 ** (52 - 6 - math.ceil(math.log2(facts["n"] * max(facts["w"], 1e-9) + 1)))
    if tasks is None:
        tasks = 1 if facts["n"] <= ONE_TASK_ROWS else max(2, min(-(-facts["n"] // TASK_ROWS), MOST_TASKS, df.sparkSession.sparkContext.defaultParallelism))
    kind = np.uint8 if max(map(len, cuts), default=0) < 256 else np.uint16
    plan = _Plan(cuts, base, scale, trees, depth, rate, share, penalty, seed)

    def block(parts: list[pa.RecordBatch]) -> tuple:
        """Bins [feature, row], label, weight, key and first log-odds of some batches."""
        each = [np.zeros((d, 0), kind), *(np.stack([np.searchsorted(c, x) for c, x in zip(cuts, _rows(part, d).T)]).astype(kind) for part in parts)]
        y, weights, keys = (np.concatenate([np.zeros(0, t), *(part.column(n).to_numpy(zero_copy_only=False) for part in parts)]) for n, t in (("y", float), ("w", float), ("key", np.int64)))
        return np.concatenate(each, axis=1), y, weights, keys.view(np.uint64), np.full(len(y), base)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held += [batch] if len(batch) else []
            if sum(map(len, held)) >= BLOCK_ROWS:
                yield block(held)
                held = []
        yield block(held)

    def held(batches: Iterator[pa.RecordBatch]) -> _Rows:
        parts = list(blocks(batches))
        return _Rows(*(np.concatenate(p, axis=-1) for p in zip(*parts)), depth)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _boost_here(held(batches), plan):
            yield pa.RecordBatch.from_pydict(_table(*found))

    def fit_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, peers = held(batches), _Peers(folder)
        for found in _boost_here(rows, plan, peers.add):
            if not peers.rank:
                yield pa.RecordBatch.from_pydict(_table(*found))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (_packed(b) for b in blocks(batches) if len(b[1]))

    if exchange is None:
        exchange = _may_exchange(df.sparkSession, facts["n"], tasks)
    folder = _shared_folder(df.sparkSession) if exchange and tasks > 1 else None
    if tasks == 1:
        found = rows.repartition(1).mapInArrow(fit, _NODES).toArrow()
    elif folder:
        found = rows.repartition(tasks).mapInArrow(fit_together, _NODES, barrier=True).toArrow()
        shutil.rmtree(folder, ignore_errors=True)  # what is left of the exchange
    else:
        packed = rows.repartition(tasks).mapInArrow(pack, _BLOCK)
        found = pa.concat_tables(pa.table(_table(*f)) for f in _boost_apart(packed.rdd.map(partial(_unpacked, d, kind)), plan))
    tree, node = found["tree"].to_numpy(), found["node"].to_numpy()
    size = (1 << (depth + 1)) - 1
    arrays = {}
    own = node >= 0
    for name in ("feature", "threshold", "value", "g", "h"):
        arrays[name] = np.full((trees, size), -1 if name == "feature" else 0, np.int32 if name == "feature" else np.float64)
        arrays[name][tree[own], node[own]] = found[name].to_numpy()[own]
    losses = np.zeros(trees + 1)
    losses[tree[~own]] = found["value"].to_numpy()[~own]
    return Trees(base, depth, losses=losses, **arrays)
