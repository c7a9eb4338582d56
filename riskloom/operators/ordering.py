"""Running totals and as-of lookups over a global order, spread over all tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import write_table


def running_totals(df: DataFrame, group: list[str], order: list[str], values: list[str], how: str = "sum",
                   before: bool = False) -> DataFrame:
    """Add ``cum_<c>``: the sum (or maximum) of c over the group up to the row.

    The row itself counts unless ``before`` is set. The input must be one row per (group, order),
    that is already aggregated, so equal values cannot pile up. Rows are range-partitioned by
    (group, order) and written once with their partition number; a group total of the earlier
    partitions (a table of at most partitions + groups rows) is combined with a window inside
    each partition. No task holds a whole group.
    """
    combine, merge, empty = {
        "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), F.lit(0)),
        "max": (F.max, lambda a, b: F.greatest(a, b), F.lit(None)),
    }[how]
    placed = write_table(
        df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "ranges"
    )
    per_part = placed.groupBy("_part", *group).agg(*[combine(c).alias(f"_t_{c}") for c in values])
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        "_part", *group, *[F.coalesce(combine(f"_t_{c}").over(earlier), empty).alias(f"_o_{c}") for c in values]
    )
    inner = (
        Window.partitionBy("_part", *group).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    )
    return (
        placed.join(F.broadcast(offsets), ["_part", *group])
        .withColumns({f"cum_{c}": merge(F.col(f"_o_{c}"), combine(c).over(inner)) for c in values})
        .drop("_part", *[f"_o_{c}" for c in values])
    )


def as_of_join(rows: DataFrame, versions: DataFrame, key: str, time: str, value: str, row_id: str = "row_id",
               version_time: str | None = None) -> DataFrame:
    """Add to each row the ``value`` of the newest version of its ``key`` that is not later than its ``time``; null without one.

    Rows and versions are stacked, range-partitioned by (key, time) and written once; the last value is carried forward inside
    each partition, and the value that a partition takes over from the earlier ones is handed to it. Only a key that runs over the
    edge of a partition has such a value, so that table has at most a row a partition. No task holds a whole key, however many rows it has,
    and rows of one key at one time are spread by ``row_id``. Nothing is joined by time ranges.

    Versions without key, time or value take no part; rows without key or time get null. Of versions with equal key and time the
    largest value counts. A column ``value`` of the rows is replaced.
    """
    version_time = version_time or time
    marks = (
        versions.select(F.col(key), F.col(version_time).alias("_time"), F.col(value).alias("_value")).na.drop()
        .groupBy(key, "_time").agg(F.max("_value").alias("_value")).withColumn("_kind", F.lit(0))
    )
    kept = rows.drop(value)
    order = ["_time", "_kind", "_tie"]
    stacked = (
        kept.withColumns({"_time": F.col(time), "_kind": F.lit(1), "_tie": F.xxhash64(row_id)})
        .unionByName(marks.withColumn("_tie", F.lit(0).cast("bigint")), allowMissingColumns=True)
    )
    placed = write_table(stacked.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()), "as_of")
    per_part = placed.groupBy("_part", key).agg(F.max_by("_value", F.when(F.col("_kind") == 0, F.col("_time"))).alias("_last"))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    edges = per_part.select(
        F.col("_part").alias("_to"), F.col(key).alias("_of"), F.last("_last", ignorenulls=True).over(earlier).alias("_taken")
    ).filter("_taken is not null")
    inner = Window.partitionBy("_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    carried = placed.withColumn("_value", F.last("_value", ignorenulls=True).over(inner)).filter("_kind = 1")
    joined = carried.join(F.broadcast(edges), (F.col("_part") == F.col("_to")) & (F.col(key) == F.col("_of")), "left")
    return joined.select(*kept.columns, F.coalesce("_value", "_taken").alias(value))
