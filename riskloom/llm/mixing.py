"""Mixing sources to target weights by repeating documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..operators.joins import lookup_join
from ..operators.ordering import running_totals
from ..session import write_table
from .common import fresh, without

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST_REPEATS = 2
SEED = 7
RESULT = ["size", "source_size", "target", "copies", "taken"]
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST_REPEATS) -> DataFrame:
    """Targets of sources from (source_key, source_size); keys are in the order in which weights repeat.

    A source's share follows its weight, but stays at ``most`` times its size; what is above goes to the others by
    weight until none is above. Every round is one small aggregate; the level rises, so a source that met
    its bound stays there.
    """
    ranked = running_totals(sizes.withColumn("_one", F.lit(1)), [], ["source_key"], ["_one"])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("cum__one") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = write_table(ranked.select("source_key", "source_size", weight.cast("bigint").alias("weight")), "sources")
    bound = (F.col("source_size") * most).cast("double")
    level, met = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > bound
        now = ranked.agg(
            F.sum("source_size").alias("all"),
            F.count(F.when(above, 1)).alias("met"),
            F.sum(F.when(above, F.col("source_size") * most).otherwise(0)).alias("bound"),
            F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        if now["met"] == met or not now["weight"]:
            break
        met, level = now["met"], (budget * now["all"] - now["bound"]) / now["weight"]
    return ranked.select("source_key", "source_size", F.least(bound, F.col("weight") * F.lit(level)).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST_REPEATS, seed: int = SEED,
                key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Each document with ``size``, ``source_size``, ``target`` (its source's), ``copies`` and ``taken`` = size * copies.

    Size is the number of words. A source's rate is target / source size; a document gets floor(rate) copies and one
    more with the probability of the fraction, drawn by a hash of the key and the seed, so reruns agree and
    equal keys draw alike. Sizes are summed per source with map-side combine; the join back
    broadcasts the targets if they are few and splits off large sources otherwise.

    Null text has size 0. Null is a source of its own, the last in order. A source whose texts are all empty has rate 0.
    An input column with the name of a result is replaced. Without rows there is nothing to take.
    """
    carried = without(docs, RESULT)
    name = fresh(docs, "source_key")
    code = F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), F.col(source)))
    sized = docs.withColumn(name, code).withColumn("size", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint"))
    totals = write_table(sized.groupBy(F.col(name).alias("source_key")).agg(F.sum("size").alias("source_size")), "source_sizes")
    targets = source_targets(totals, weights, budget, most).withColumnRenamed("source_key", name)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    draw = fresh(docs, "draw")
    extra = uniform(seed, "mix", draw) < rate - F.floor(rate)
    sized = sized.withColumn(draw, F.coalesce(F.col(key).cast("string"), F.lit("")))
    joined = lookup_join(sized.select(*carried, name, "size", draw), targets, name)
    return (
        joined.withColumn("copies", F.floor(rate) + F.when(extra, 1).otherwise(0))
        .select(*carried, "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )


def emit_copies(mixed: DataFrame) -> DataFrame:
    """Each document as often as ``copies`` says."""
    return mixed.withColumn("copies", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).drop("copies")
