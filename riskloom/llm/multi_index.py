"""Approximate nearest neighbours by an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import write_table

NEIGHBOURS = 5
CENTROIDS = 128
SAMPLE_ROWS = 20_000
SHARE = 0.35
ROUNDS = 10
LEAST_BLOCK, MOST_BLOCK = 256, 32_768
PROBES_AT_ONCE = 64


def usable(table: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """Rows (id, vector as doubles) that take part, and their dimension, the most frequent length.

    Null, zero and non-finite vectors, those that hold a null, of another length or without an id are left out.
    """
    rows = table.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector")).filter(
        F.col("id").isNotNull()
        & F.col("vector").isNotNull()
        & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    d = sizes["d"] if sizes else 2
    return rows.filter(F.size("vector") == d), d


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(axis=1)


def quantiser(x: np.ndarray, most: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Centroids of one half by k-means from distinct rows."""
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    centroids = distinct[np.sort(rng.permutation(len(distinct))[:most])]
    for _ in range(rounds):
        near = _distances(x, centroids).argmin(axis=1)
        order = np.argsort(near, kind="stable")
        here, first = np.unique(near[order], return_index=True)
        centroids = centroids.copy()
        centroids[here] = np.add.reduceat(x[order], first, axis=0) / np.diff(np.append(first, len(x)))[:, None]
    return centroids


def traverse(left: np.ndarray, right: np.ndarray, counts: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Cells in order of summed distance until they hold ``enough`` entries (multi-sequence algorithm)."""
    a, b = np.argsort(left, kind="stable").tolist(), np.argsort(right, kind="stable").tolist()
    x, y, size = left[a].tolist(), right[b].tolist(), counts[a][:, b].tolist()
    heap, out, held = [(x[0] + y[0], 0, 0)], [], 0
    reached = [-1] * len(b)  # how far each column has been taken
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        reached[j] = i
        if size[i][j]:
            out.append((a[i], b[j]))
            held += size[i][j]
        if i + 1 < len(a) and (j == 0 or reached[j - 1] >= i + 1):
            heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
        if j + 1 < len(b) and (i == 0 or reached[j + 1] >= i - 1):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
    return out


def nearest(table: DataFrame, every: int = 50, neighbours: int = NEIGHBOURS, share: float = SHARE, centroids: int = CENTROIDS,
            sample_rows: int = SAMPLE_ROWS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``neighbours`` rows of largest cosine found for each row whose id is divisible by ``every``.

    Vectors are scaled to length one and cut in half; each half has its own centroids, fitted on the
    ``sample_rows`` rows with the smallest hash. Every row is an entry of the cell of its two nearest centroids. A query
    takes cells in order of summed distance until they hold ``share`` of all entries, and these are compared
    exactly, in double precision, on the original vectors. Without cluster structure a recall above 0.9 needs a third
    of the entries; with it a smaller share will do.

    Entries and queries meet by the first half's centroid, whose entries lie in blocks of at most 32,768, so a centroid with any
    number of entries is spread. Every entry goes to one block, a query to the blocks of the centroids it opens; there its probes pass
    by the block's entries. What is shuffled grows with entries and probes; a block gives at most ``neighbours`` rows a query. Ties go to the smaller id. Rows
    of equal id are rows of their own: each is a query, and only the row itself is left out. Other columns are not read.
    An empty table gives an empty one.
    """
    rows, d = usable(table, key, vector)
    rows = write_table(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    total = rows.count()
    half = max(1, d // 2)
    drawn = rows.select("id", "row", "vector").orderBy(F.xxhash64("id", "row"), "row").limit(sample_rows).select("vector").toArrow()["vector"].combine_chunks()
    fitted = _unit(_matrix(drawn, d)) if total else np.zeros((0, d))
    halves = [quantiser(part, centroids) if total and part.shape[1] else np.zeros((1, part.shape[1])) for part in (fitted[:, :half], fitted[:, half:])]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(_matrix(batch.column("vector"), d))
            cells = [pa.array(_distances(x, c).argmin(axis=1).astype(np.int32)) for x, c in zip((unit[:, :half], unit[:, half:]), halves)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cells], [*batch.schema.names, "i", "j"])

    entry = "id long, vector array<double>, row long, i int, j int"
    index = write_table(rows.select(F.col("id").cast("long"), "vector", "row").mapInArrow(place, entry), "index")
    counts = np.zeros((len(halves[0]), len(halves[1])), np.int64)
    for r in index.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["i"], r["j"]] = r["n"]
    enough = max(neighbours + 1, int(np.ceil(share * total)))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(_matrix(batch.column("vector"), d))
            near = [_distances(x, c) for x, c in zip((unit[:, :half], unit[:, half:]), halves)]
            at, first, cells = [], [], []
            for q in range(len(unit)):
                taken: dict[int, list[int]] = {}
                for i, j in traverse(near[0][q], near[1][q], counts, enough):
                    taken.setdefault(i, []).append(j)
                for i, js in taken.items():
                    mask = np.zeros(counts.shape[1], np.uint8)
                    mask[js] = 1
                    at.append(q)
                    first.append(i)
                    cells.append(np.packbits(mask).tobytes())
            who = batch.select(["id", "vector", "row"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*who.columns, pa.array(first, pa.int32()), pa.array(cells, pa.binary())], ["id", "vector", "row", "i", "cells"])

    block = min(MOST_BLOCK, max(LEAST_BLOCK, -(-total // max(1, len(halves[0])))))
    blocks = np.maximum(1, -(-counts.sum(axis=1) // block)).tolist()
    of_i = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), F.col("i") + 1)
    asked = index.filter(F.col("id") % every == 0)
    entries = index.select("i", F.pmod(F.xxhash64("row"), of_i).cast("long").alias("part"), F.lit(0).alias("kind"), "id", "vector", "row", "j", F.lit(None).cast("binary").alias("cells"))
    tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, so that few queries still spread
    spread = asked.select("id", "vector", "row").repartition(tasks, "row")
    probes = spread.mapInArrow(probe, "id long, vector array<double>, row long, i int, cells binary").select(
        "i", F.explode(F.sequence(F.lit(0).cast("long"), of_i.cast("long") - 1)).alias("part"), F.lit(1).alias("kind"), "id", "vector", "row", F.lit(0).alias("j"), "cells",
    )
    result = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.float64())])

    def compare(held: list[pa.RecordBatch], asks: pa.RecordBatch) -> pa.RecordBatch:
        out = {name: [] for name in result.names}
        entries_ = pa.Table.from_batches(held)
        x, q = _matrix(entries_["vector"].combine_chunks(), d), _matrix(asks.column("vector"), d)
        length, own = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
        ids, rows_, j = (entries_[c].to_numpy() for c in ("id", "row", "j"))
        about = (q / own[:, None]) @ (x / length[:, None]).T
        open_ = np.unpackbits(np.frombuffer(b"".join(asks.column("cells").to_pylist()), np.uint8).reshape(len(q), -1), axis=1)[:, j]
        asking = asks.column("row").to_numpy()
        about[(open_ == 0) | (rows_ == asking[:, None])] = -np.inf
        for k, query in enumerate(asks.column("id").to_pylist()):
            found = np.flatnonzero(about[k] > -np.inf)
            if len(found) > neighbours:
                least = np.partition(about[k], -neighbours)[-neighbours]
                found = np.flatnonzero(about[k] >= least - 1e-9)
            score = (x[found] * q[k]).sum(axis=1) / (length[found] * own[k])
            best = np.lexsort((rows_[found], ids[found], -score))[:neighbours]
            out["query_row"] += [int(asking[k])] * len(best)
            out["query_id"] += [query] * len(best)
            out["vec_id"] += ids[found[best]].tolist()
            out["row"] += rows_[found[best]].tolist()
            out["score"] += score[best].tolist()
        return pa.RecordBatch.from_pydict(out, schema=result)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The entries of a block come first and are held; the probes that follow pass by them, some at a time."""
        now, held = None, []
        for batch in batches:
            group = np.stack([batch.column(c).to_numpy() for c in ("i", "part", "kind")], axis=1)
            bounds = np.append(np.flatnonzero(np.append(True, (group[1:] != group[:-1]).any(axis=1))), len(batch))
            for low, high in zip(bounds[:-1], bounds[1:]):
                i, part, kind = group[low].tolist()
                if (i, part) != now:
                    now, held = (i, part), []
                if not kind:
                    held.append(batch.slice(low, high - low))
                elif held:
                    for at in range(low, high, PROBES_AT_ONCE):
                        yield compare(held, batch.slice(at, min(PROBES_AT_ONCE, high - at)))

    dealt = entries.unionByName(probes).repartition(tasks, "i", "part").sortWithinPartitions("i", "part", "kind")
    found = dealt.mapInArrow(meet, "query_row long, query_id long, vec_id long, row long, score double")
    order = Window.partitionBy("query_row", "query_id").orderBy(F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= neighbours)
    return ranked.select("query_id", "rank", "vec_id", "score")
