"""Exact-size random selection and stratified splits without a global sort.

Rows are ordered by (hash, row_id). Which rows are among the first k is decided by one cut-off
point in that order, so the result is a plain per-row predicate. The cut-off is found from a
histogram over the top 16 bits of the hash and a second one inside a single bucket.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash32
from ..session import write_table
from .joins import lookup_join

LOW_BITS = 1 << 16


def _first_k_by_stratum(
    df: DataFrame, h: Column, row_id: str, stratum: Column, quota: Callable[[dict], dict]
) -> dict[object, Column]:
    """Predicate per stratum that holds for its first ``quota`` rows; at most 2^16 counts per stratum."""
    keyed = df.select(stratum.alias("s"), h.alias("h"), F.col(row_id).alias("id"))
    histogram = _counts(keyed.groupBy("s", F.floor(F.col("h") / LOW_BITS).alias("b")).count())
    sizes = {s: sum(n for _, n in buckets) for s, buckets in histogram.items()}
    quotas = quota(sizes)

    out: dict[object, Column] = {}
    open_bucket: dict[object, tuple[int, int]] = {}
    for s, buckets in histogram.items():
        k = quotas.get(s, 0)
        if k <= 0:
            out[s] = F.lit(False)
        elif k >= sizes[s]:
            out[s] = F.lit(True)
        else:
            for b, n in sorted(buckets):
                if n >= k:
                    open_bucket[s] = (b, k)
                    break
                k -= n
    if not open_bucket:
        return out

    # the hash alone is tested, so the filter does not repeat the work behind the stratum
    bucket = F.floor(F.col("h") / LOW_BITS)
    fine = _counts(keyed.filter(bucket.isin([b for b, _ in open_bucket.values()])).groupBy("s", "h").count())
    for s, (b, k) in open_bucket.items():
        for value, n in sorted((v, n) for v, n in fine[s] if v // LOW_BITS == b):
            if n >= k:
                break
            k -= n
        if n == k:
            out[s] = h <= value
        else:
            # equal hashes: the row key decides; about n / 2^32 rows share one hash
            tied = keyed.filter(F.col("s").eqNullSafe(F.lit(s)) & (F.col("h") == value))
            last = tied.orderBy("id").limit(k).agg(F.max("id")).first()[0]
            out[s] = (h < value) | ((h == value) & (F.col(row_id) <= F.lit(last)))
    return out


def _counts(grouped: DataFrame) -> dict[object, list[tuple[int, int]]]:
    """(value, count) pairs per stratum; Arrow keeps the transfer of some 10,000 rows short."""
    out = defaultdict(list)
    stratum, value, count = (c.to_pylist() for c in grouped.toArrow().columns)
    for s, v, n in zip(stratum, value, count):
        out[s].append((v, n))
    return out


def random_k(df: DataFrame, k_of_n: Callable[[int], int], seed, salt: str, row_id: str = "row_id",
             eligible: Column | None = None) -> Column:
    """Predicate that holds for exactly ``k_of_n(n)`` of the n eligible rows."""
    eligible = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
    h = hash32(seed, salt, row_id)
    chosen = _first_k_by_stratum(
        df.filter(eligible), h, row_id, F.lit(0), lambda sizes: {0: k_of_n(sizes.get(0, 0))}
    )
    return eligible & chosen.get(0, F.lit(False))


def split_quotas(sizes: dict, test_size: float = 0.25) -> dict:
    """Test rows per class: ceil(test_size n) in total, train rows by largest remainder."""
    n = sum(sizes.values())
    n_test = math.ceil(test_size * n)
    n_train = n - n_test
    if n_train == 0 or n_test == 0:
        raise ValueError("too few rows to split")
    if len(sizes) > 1 and min(sizes.values()) < 2:
        raise ValueError("every class needs at least two rows to be split")
    if len(sizes) > min(n_train, n_test):
        raise ValueError("each side of the split must be able to hold every class")
    share = {c: n_train * m / n for c, m in sizes.items()}
    train = {c: math.floor(v) for c, v in share.items()}
    left = n_train - sum(train.values())
    for c in sorted(sizes, key=lambda c: (-(share[c] - train[c]), c))[:left]:
        train[c] += 1
    return {c: sizes[c] - train[c] for c in sizes}


def stratified_split(df: DataFrame, seed=42, test_size: float = 0.25, label: str = "y", row_id: str = "row_id") -> DataFrame:
    """Add ``split`` ('train' / 'test'); sizes are exact per class and the draw is seeded."""
    h = hash32(seed, "split", row_id)
    chosen = _first_k_by_stratum(df, h, row_id, F.col(label), lambda sizes: split_quotas(sizes, test_size))
    is_test = F.lit(False)
    for c, predicate in chosen.items():
        is_test = is_test | ((F.col(label) == F.lit(c)) & predicate)
    return df.withColumn("split", F.when(is_test, "test").otherwise("train"))


def split_by_group(df: DataFrame, group: str = "user_id", seed=42, test_size: float = 0.25, label: str = "y") -> DataFrame:
    """Add ``split`` ('train' / 'test') so that all rows of a group are on one side; the draw is seeded.

    Groups with a row of the largest label and the others are drawn apart, in the order of a hash of the group, until the test side has its
    share of the rows. What one stratum has too many or too few is made up for in the next, so the test side is off by less than one largest group.
    The cut-off comes from a histogram of rows over 16 bits of the hash and a second one in one bucket; groups with equal hashes count as
    one. Rows are joined with the sides of their groups, split further where a group is hot. Rows without a group are one group, rows
    without a label count as label 0. A side that would be empty raises, and so does a single group.
    """
    keyed = df.withColumn("_group", F.coalesce(F.col(group).cast("string"), F.lit("")))
    sizes = write_table(
        keyed.groupBy("_group").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(label), F.lit(0)).cast("double").alias("s"))
        .withColumn("h", hash32(seed, "split", "_group")), "groups",
    )
    buckets = _counts(sizes.groupBy("s", F.floor(F.col("h") / LOW_BITS).alias("b")).agg(F.sum("n")))
    owed, cuts = 0.0, {}
    for s in sorted(buckets, reverse=True):
        want = test_size * sum(n for _, n in buckets[s]) + owed
        taken = 0
        for b, n in sorted(buckets[s]):
            if taken + n > want:
                break
            taken += n
        else:
            cuts[s], owed = (1 << 32) - 1, want - taken
            continue
        cuts[s] = b * LOW_BITS - 1
        inside = sizes.filter((F.col("s") == s) & (F.floor(F.col("h") / LOW_BITS) == b)).groupBy("s", "h").agg(F.sum("n"))
        for value, n in sorted(_counts(inside)[s]):
            if taken + n - want > want - taken:  # without this group it is nearer
                break
            taken, cuts[s] = taken + n, value
        owed = want - taken
    is_test = F.lit(False)
    for s, cut in cuts.items():
        is_test = is_test | ((F.col("s") == s) & (F.col("h") <= cut))
    sides = write_table(sizes.select("_group", is_test.alias("_test")), "sides")
    if sides.agg(F.count_distinct("_test")).first()[0] < 2:
        raise ValueError("too few groups to split")
    joined = lookup_join(keyed, sides, "_group", counted=keyed.select("_group"))
    return joined.select(*df.drop("split").columns, F.when(F.col("_test"), "test").otherwise("train").alias("split"))
