"""SimHash near-duplicates: fingerprints, and their links by the generalised pigeonhole principle."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from ..session import write_table
from .bytescan import IS_SPACE, LOWER_AZ, flat_bytes, runs_of_bytes, words
from .common import fresh, without
from .components import components

SHINGLE = 4
DISTANCE = 4
SEED = 42
BITS = 64
RUN_BYTES = 1 << 20
SHINGLES_AT_ONCE = 1 << 18
PAIRS_AT_ONCE = 1 << 20
CELL_ROWS = 4096
ESTIMATE_BITS = 11
PROBE_COST = 2.0
SAMPLE = 1024
RESULT = ["fingerprint", "component_id", "kept"]


# ---- fingerprints -------------------------------------------------------------------------------

def _joined(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words joined by single spaces: bytes, start and end of each word, words of each text."""
    starts, ends, counts = words(data, offsets)
    later = np.ones(len(starts), bool)
    first = np.cumsum(counts) - counts
    later[first[counts > 0]] = False
    gap = starts[later] - 1
    keep = ~IS_SPACE[data]
    keep[gap] = True
    lowered = LOWER_AZ[data]
    lowered[gap] = 32
    place = np.append(0, np.cumsum(keep))
    return lowered[keep].tobytes(), place[starts], place[ends], counts


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprint of each text: a bit is set if it is set in over half the shingles' XXH64. No words: 0."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    weights = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    for a, b in runs_of_bytes(offsets, RUN_BYTES):
        at = offsets[a : b + 1] - offsets[a]
        text, starts, ends, counts = _joined(data[offsets[a] : offsets[b]], at)
        own = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
        total = int(own.sum())
        if not total:
            continue
        doc = np.repeat(np.arange(b - a), own)
        begin = np.repeat(np.cumsum(counts) - counts - np.cumsum(own) + own, own) + np.arange(total)
        stop = ends[begin + np.repeat(np.minimum(counts, shingle), own) - 1]
        begin = starts[begin]
        votes = np.zeros((b - a, BITS), np.int64)
        for low in range(0, total, SHINGLES_AT_ONCE):
            some = slice(low, low + SHINGLES_AT_ONCE)
            hashes = np.array([xxhash.xxh64_intdigest(text[s:e], SEED) for s, e in zip(begin[some].tolist(), stop[some].tolist())], np.uint64)
            bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS)
            here, first = np.unique(doc[some], return_index=True)
            votes[here] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        out[a:b] = ((2 * votes > own[:, None]) * weights).sum(axis=1, dtype=np.uint64)
    return out


# ---- partitions of the bits and thresholds ------------------------------------------------------

def bit_groups(together: np.ndarray, rows: int, groups: int) -> list[list[int]]:
    """Bits in ``groups`` parts of nearly equal width, correlated ones together.

    ``together[i, j]`` counts the fingerprints with both bits set. A part starts from the free bit that is most
    correlated with the other free ones and takes in turn the bit most correlated with what it holds.
    """
    share = np.diag(together) / max(rows, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    tie = np.abs((together / max(rows, 1) - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    free, parts = list(range(BITS)), []
    for width in (BITS // groups + (i < BITS % groups) for i in range(groups)):
        part = [max(free, key=lambda b: (tie[b, free].sum(), -b))]
        free.remove(part[0])
        while len(part) < width:
            part.append(max(free, key=lambda b: (tie[b, part].sum(), -b)))
            free.remove(part[-1])
        parts.append(sorted(part))
    return parts


def gather_bits(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """The named bits of each value, packed together."""
    out = np.zeros(len(values), np.uint64)
    for k, b in enumerate(bits):
        out |= ((values >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def distance_counts(histogram: np.ndarray, most: int) -> np.ndarray:
    """[d, v]: how many counted values lie at exactly d differing bits from v, for d up to ``most``."""
    found = np.zeros((most + 1, len(histogram)))
    found[0] = histogram
    flat = np.arange(len(histogram))
    for bit in range(len(histogram).bit_length() - 1):
        found[1:] += found[:-1][:, flat ^ (1 << bit)]
    return found


class Plan:
    """Parts of the bits, and for any value the thresholds that should give the fewest probes and candidates."""

    def __init__(self, parts: list[list[int]], distance: int):
        self.parts, self.distance = parts, distance
        self.pieces = [[p[i : i + ESTIMATE_BITS] for i in range(0, len(p), ESTIMATE_BITS)] for p in parts]
        self.flat = [bits for pieces in self.pieces for bits in pieces]
        self.masks = []
        for part in parts:
            flips = [[0]]
            for t in range(1, distance + 1):
                flips.append([sum(1 << i for i in c) for c in combinations(range(len(part)), t)] if t <= 2 or math.comb(len(part), t) <= 50_000 else None)
            self.masks.append(flips)
        self.counts: list[np.ndarray] = []
        self.rows = 0

    def learn(self, histograms: list[np.ndarray], rows: int) -> None:
        self.counts, self.rows = [distance_counts(h, self.distance) for h in histograms], max(rows, 1)

    def candidates(self, part: int, values: np.ndarray) -> np.ndarray:
        """[value, t]: estimated number of rows whose part differs in at most t bits, pieces of a part taken as independent."""
        total = np.zeros((len(values), self.distance + 1))
        total[:, 0] = self.rows
        at = sum(len(p) for p in self.pieces[:part])
        for k in range(len(self.pieces[part])):
            own = self.counts[at + k][:, gather_bits(values, self.flat[at + k]).astype(np.int64)].T / self.rows
            total = np.stack([sum(total[:, i] * own[:, d - i] for i in range(d + 1)) for d in range(self.distance + 1)], axis=1)
        return np.cumsum(total, axis=1)

    def _allocate(self, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Least cost of each value, infinite if no part can take enough bits, and by part the units taken."""
        units, n = self.distance + 1, len(values)
        best = np.full((n, units + 1), np.inf)
        best[:, 0] = 0
        taken = []
        for part, flips in enumerate(self.masks):
            near = self.candidates(part, values)
            cost = np.zeros((n, units + 1))
            probes = 0
            for t in range(self.distance + 1):
                probes = probes + len(flips[t]) if flips[t] is not None else np.inf
                cost[:, t + 1] = near[:, t] + PROBE_COST * probes
            options = np.full((n, units + 1, units + 1), np.inf)
            for u in range(units + 1):
                for k in range(u + 1):
                    options[:, u, k] = best[:, u - k] + cost[:, k]
            taken.append(options.argmin(axis=2))
            best = options.min(axis=2)
        return best[:, units], taken

    def cost(self, values: np.ndarray) -> float:
        """Mean estimated cost of a value: probes and candidates."""
        return float(self._allocate(values)[0].mean())

    def thresholds(self, values: np.ndarray) -> np.ndarray:
        """[value, part]: allowed differing bits in each part, -1 for none, by dynamic programming.

        Thresholds of sum distance - parts + 1 lose no pair: a pair that is above all of them differs in at least
        (sum + parts) = distance + 1 bits. Raises if the parts cannot take that many.
        """
        units, n = self.distance + 1, len(values)
        best, taken = self._allocate(values)
        if not np.isfinite(best).all():
            raise ValueError(f"{len(self.parts)} parts cannot hold a distance of {self.distance}")
        out, left = np.empty((n, len(self.masks)), np.int64), np.full(n, units)
        for part in range(len(self.masks) - 1, -1, -1):
            k = taken[part][np.arange(n), left]
            out[:, part] = k - 1
            left = left - k
        return out

    def cell(self, part: int, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(BITS) + np.uint64(part)).view(np.int64)

    def probes(self, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(cells, values) to look into."""
        allowed = self.thresholds(values)
        for part, flips in enumerate(self.masks):
            keys = gather_bits(values, self.parts[part])
            for t in range(self.distance + 1):
                some = np.flatnonzero(allowed[:, part] >= t)
                if len(some):
                    masks = np.array(flips[t], np.uint64)
                    for low in range(0, len(some), max(1, PAIRS_AT_ONCE // len(masks))):
                        few = some[low : low + max(1, PAIRS_AT_ONCE // len(masks))]
                        yield self.cell(part, (keys[few][:, None] ^ masks).ravel()), np.repeat(values[few], len(masks))


def cheapest(plans: list[Plan], sample: np.ndarray) -> Plan:
    """The plan with the least estimated cost over the sampled values; raises if none can hold the distance."""
    costs = [plan.cost(sample) if len(sample) else len(plan.parts) for plan in plans]
    if not np.isfinite(costs).any():
        raise ValueError(f"no number of parts can hold a distance of {plans[0].distance}")
    return plans[int(np.argmin(costs))]


# ---- links --------------------------------------------------------------------------------------

def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A few links with the same components: each node to the smallest of its component."""
    nodes, where = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = where[: len(u)], where[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root != root[root]).any():
            root = root[root]
        if (before == root).all():
            break
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def _cell_links(cells: np.ndarray, probe: np.ndarray, value: np.ndarray, distance: int):
    """Links within cells; rows are in order of cell, stored values before probes."""
    change = np.flatnonzero(np.diff(cells)) + 1
    begin = np.append(0, change)
    group = np.zeros(len(cells), np.int64)
    group[change] = 1
    group = np.cumsum(group)
    stored = np.add.reduceat((~probe).astype(np.int64), begin)
    asks = np.flatnonzero(probe & (stored[group] > 0))
    size = stored[group[asks]]
    total = np.append(0, np.cumsum(size))
    low = 0
    while low < len(asks):
        high = max(low + 1, int(np.searchsorted(total, total[low] + PAIRS_AT_ONCE, "right")) - 1)
        some, n = asks[low:high], size[low:high]
        left = np.repeat(value[some], n)
        right = value[np.arange(total[high] - total[low]) + np.repeat(begin[group[some]] - (total[low:high] - total[low]), n)]
        near = (np.bitwise_count(left ^ right) <= distance) & (left != right)
        if near.any():
            yield forest(left[near], right[near])
        low = high


def fingerprint_links(values: DataFrame, distance: int = DISTANCE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (u, v) that join exactly the fingerprints ``fp`` (distinct longs) reachable over ``distance`` or fewer bits.

    The bits are put into parts by their correlation over all fingerprints; the number of parts is that with the least
    estimated cost over 1,024 of them, up to three or as many as are wider than the bits of the row count. Per fingerprint, thresholds for the
    parts come from dynamic programming on estimated candidates, and it probes the cells of all part values within its
    thresholds. Rows meet by cell; every candidate is checked. A cell with more than ``cell_rows`` stored fingerprints is
    split into blocks on both sides, and each pair of blocks meets in a group of its own. A group passes on a
    spanning forest of what it found, never all its pairs.
    """
    spark = values.sparkSession
    rows = values.count()

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            bits = np.unpackbits(fp.view(np.uint8), bitorder="little").reshape(-1, BITS).astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(total.ravel())], ["at", "n"])

    together = np.zeros(BITS * BITS, np.int64)
    for r in values.mapInArrow(pairs, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        together[r["at"]] = r["n"]
    most = max(2, min(distance + 1, max(3, int(BITS // (math.log2(max(rows, 2)) + 1)))))
    plans = [Plan(bit_groups(together.reshape(BITS, BITS), rows, groups), distance) for groups in range(2, most + 1)]
    flat = [bits for plan in plans for bits in plan.flat]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(1 << len(bits), np.int64) for bits in flat]
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for k, bits in enumerate(flat):
                total[k] += np.bincount(gather_bits(fp, bits).astype(np.int64), minlength=len(total[k]))
        for k, found in enumerate(total):
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(found[at])], ["piece", "at", "n"])

    histograms = [np.zeros(1 << len(bits)) for bits in flat]
    for r in values.mapInArrow(count, "piece long, at long, n long").groupBy("piece", "at").agg(F.sum("n").alias("n")).collect():
        histograms[r["piece"]][r["at"]] = r["n"]
    for each in plans:
        each.learn(histograms[: len(each.flat)], rows)
        del histograms[: len(each.flat)]
    sample = values.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    plan = cheapest(plans, np.array([r["fp"] for r in sample], np.int64).view(np.uint64))

    def batch_of(cells: np.ndarray, fp: np.ndarray, probe: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.full(len(fp), probe)), pa.array(fp.view(np.int64))], ["cell", "probe", "fp"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for part, bits in enumerate(plan.parts):
                yield batch_of(plan.cell(part, gather_bits(fp, bits)), fp, False)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for cells, who in plan.probes(fp):
                yield batch_of(cells, who, True)

    cells = "cell long, probe boolean, fp long"
    stored = values.mapInArrow(store, cells)
    crowded = write_table(
        stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell_rows)
        .select("cell", F.ceil(F.col("n") / cell_rows).cast("int").alias("blocks")), "crowded"
    )
    both = lookup_join(stored.unionByName(values.mapInArrow(ask, cells)), crowded, "cell")
    blocks = F.coalesce("blocks", F.lit(1))
    own, other = F.pmod(F.xxhash64("fp"), blocks), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    placed = both.select("cell", "probe", "fp", own.alias("own"), other).select(
        "cell", "probe", "fp",
        F.when(F.col("probe"), F.col("own")).otherwise(F.col("other")).cast("int").alias("asking"),
        F.when(F.col("probe"), F.col("other")).otherwise(F.col("own")).cast("int").alias("holding"),
    )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def found(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            cell, probe, fp, asking, holding = columns
            new = np.append(False, (np.diff(cell) != 0) | (np.diff(asking) != 0) | (np.diff(holding) != 0))
            for u, v in _cell_links(np.cumsum(new), probe, fp.view(np.uint64), distance):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held:
                columns = [np.concatenate(pair) for pair in zip(held, columns)]
            last = np.flatnonzero((columns[0] != columns[0][-1]) | (columns[3] != columns[3][-1]) | (columns[4] != columns[4][-1]))
            if len(last):
                yield from found([c[: last[-1] + 1] for c in columns])
                columns = [c[last[-1] + 1 :] for c in columns]
            held = columns
        if held and len(held[0]):
            yield from found(held)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = placed.repartition(parts, "cell", "asking", "holding").sortWithinPartitions("cell", "asking", "holding", "probe")
    return met.mapInArrow(link, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, key: str = "doc_id", text: str = "text",
                    carry: list[str] | None = None) -> DataFrame:
    """Every row with ``fingerprint`` (16 hex digits), ``component_id`` and ``kept``.

    ``component_id`` is the smallest key among the rows reachable over links of ``distance`` or fewer differing bits,
    the row itself included; null keys come last. ``kept`` marks one row of each component, that with this
    key (of equal keys one). Texts without words (null, empty, white space) have fingerprint 0 and link like others;
    texts shorter than a shingle are one shingle. Links are sought between distinct fingerprints only, so a text with
    any number of copies costs as much as one. ``carry`` names the columns that come along (default: all); an input column
    with the name of a result is replaced. An empty table gives an empty one.
    """
    carried = [c for c in without(docs, RESULT) if carry is None or c in carry]

    @F.arrow_udf("long")
    def fingerprint(column: pa.Array) -> pa.Array:
        return pa.array(fingerprints(*flat_bytes(column), shingle).view(np.int64))

    row, own, fp = fresh(docs, "_row"), fresh(docs, "_key"), fresh(docs, "_fp")
    marked = write_table(
        docs.select(*carried, F.col(key).alias(own), fingerprint(F.col(text)).alias(fp)).withColumn(row, F.monotonically_increasing_id()),
        "fingerprints",
    )
    first = F.struct(F.col(own).isNull().alias("none"), F.col(own).alias("key"), F.col(row).alias("row"))
    distinct = write_table(marked.groupBy(F.col(fp).alias("fp")).agg(F.min(first).alias("first")), "distinct")
    roots = components(fingerprint_links(distinct.select("fp"), distance))
    rooted = write_table(
        distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted"
    )
    heads = write_table(rooted.groupBy("root").agg(F.min("first").alias("head")), "heads")
    classes = write_table(rooted.select("fp", "root").join(heads, "root").select(F.col("fp").alias(fp), "head"), "classes")
    return marked.join(classes, fp).select(
        *carried,
        F.lower(F.lpad(F.hex(fp), 16, "0")).alias("fingerprint"),
        F.col("head.key").alias("component_id"),
        (F.col(row) == F.col("head.row")).alias("kept"),
    )
