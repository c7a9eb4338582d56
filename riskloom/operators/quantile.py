"""Exact interpolated percentiles with bounded memory.

Spark's ``percentile`` holds all distinct values in one task. Here approximate percentiles only
bracket the wanted ranks; counting passes check and narrow the bracket until few values are
left, and these give the exact result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FETCH_VALUES = 20_000  # values a final fetch may bring to the driver, over all columns
GROUP_COLUMNS = 20
ACCURACY = 2_000
FIRST_MARGIN = 3.0 / ACCURACY


@dataclass
class _Rank:
    """Search for the value at one rank of column ``i``: it lies strictly between low and high.

    The ends of a bracket are tested apart from its inside. So every step either finds the value
    or drops both ends with all their copies, however often a value repeats.
    """

    i: int
    rank: int
    inside: int
    below: int = 0
    low: float = -math.inf
    high: float = math.inf
    open: bool = True  # not narrowed yet; infinite ends are values like others
    margin: float = FIRST_MARGIN
    value: float | None = None

    def within(self) -> Column:
        v = F.col(f"v{self.i}")
        if self.open:
            return v.isNotNull()
        return (v > F.lit(self.low)) & (v < F.lit(self.high))

    def shares(self) -> list[float]:
        at = (self.rank - self.below) / max(1, self.inside - 1)
        return [max(0.0, at - self.margin), min(1.0, at + self.margin)]

    def narrow(self, low: float, high: float, below: int, inside: int, at_low: int, at_high: int) -> None:
        if not below <= self.rank < below + inside:
            self.margin *= 2
        elif self.rank < below + at_low:
            self.value = low
        elif self.rank >= below + inside - at_high:
            self.value = high
        else:
            self.low, self.high, self.open = low, high, False
            self.below, self.inside = below + at_low, inside - at_low - at_high


def exact_percentiles(df: DataFrame, wanted: dict[str, tuple[Column, float]]) -> dict[str, float | None]:
    """Linear-interpolated percentiles, several at once: ``{name: (column, q)}``.

    Nulls and NaN are skipped; None when there is no value. Columns are searched in groups, so that the final
    fetch of a group stays within ``FETCH_VALUES`` and leaves each rank enough to finish in a few passes.
    """
    names = list(wanted)
    if len(names) > GROUP_COLUMNS:
        return {
            name: value
            for first in range(0, len(names), GROUP_COLUMNS)
            for name, value in exact_percentiles(df, {n: wanted[n] for n in names[first : first + GROUP_COLUMNS]}).items()
        }
    values = df.select(
        *[F.when(~F.isnan(c.cast("double")), c.cast("double")).alias(f"v{i}") for i, (c, _) in enumerate(wanted.values())]
    )
    # the first bracket does not depend on the count, so both come from one pass
    seen = values.agg(
        *[F.count(f"v{i}").alias(f"n{i}") for i in range(len(names))],
        *[
            F.percentile_approx(f"v{i}", [max(0.0, q - FIRST_MARGIN), min(1.0, q + FIRST_MARGIN)], ACCURACY).alias(f"p{i}")
            for i, (_, q) in enumerate(wanted.values())
        ],
    ).first()
    limit = FETCH_VALUES // (2 * len(names)) if names else 0
    search: list[_Rank] = []
    for i, name in enumerate(names):
        n = seen[f"n{i}"]
        if n:
            low = math.floor(wanted[name][1] * (n - 1))
            search += [_Rank(i, low, n), _Rank(i, min(low + 1, n - 1), n)]

    first = True
    while True:
        active = [s for s in search if s.value is None and s.inside > limit]
        if not active:
            break
        if first:
            brackets, first = [seen[f"p{s.i}"] for s in active], False
        else:
            brackets = values.agg(
                *[F.percentile_approx(F.when(s.within(), F.col(f"v{s.i}")), s.shares(), ACCURACY) for s in active]
            ).first()
        aggregates = []
        for s, (low, high) in zip(active, brackets):
            v = F.col(f"v{s.i}")
            aggregates += [
                F.count_if(v < F.lit(low)), F.count_if(v.between(F.lit(low), F.lit(high))),
                F.count_if(v == F.lit(low)), F.count_if(v == F.lit(high)),
            ]
        counted = values.agg(*[a.alias(f"a{k}") for k, a in enumerate(aggregates)]).first()
        for k, (s, (low, high)) in enumerate(zip(active, brackets)):
            s.narrow(low, high, *counted[4 * k : 4 * k + 4])

    _fetch(values, [s for s in search if s.value is None])
    result: dict[str, float | None] = {name: None for name in names}
    for a, b in zip(search[::2], search[1::2]):
        position = wanted[names[a.i]][1] * (seen[f"n{a.i}"] - 1)
        share = position - math.floor(position)
        result[names[a.i]] = a.value if a.value == b.value or not share else a.value + (b.value - a.value) * share
    return result


def _fetch(values: DataFrame, search: list[_Rank]) -> None:
    """Bring the few values left in each bracket to the driver and pick the rank."""
    if not search:
        return
    cells = F.array(
        *[F.struct(F.lit(k).alias("k"), F.when(s.within(), F.col(f"v{s.i}")).alias("v")) for k, s in enumerate(search)]
    )
    left = values.select(F.explode(cells).alias("c")).filter(F.col("c.v").isNotNull()).groupBy("c.k", "c.v").count()
    found: dict[int, list[tuple[float, int]]] = {}
    for k, v, n in zip(*(c.to_pylist() for c in left.toArrow().columns)):
        found.setdefault(k, []).append((v, n))
    for k, s in enumerate(search):
        rank = s.rank - s.below
        for value, n in sorted(found[k]):
            if rank < n:
                s.value = value
                break
            rank -= n


def exact_percentile(df: DataFrame, column: Column, q: float) -> float | None:
    return exact_percentiles(df, {"p": (column, q)})["p"]
