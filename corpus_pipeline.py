"""From raw documents to packed training sequences: five stages, each a table of its own.

Every stage works on all its predecessor kept: toxic documents go, of equal texts one stays, of near duplicates one stays,
sources are mixed to their target weights by repeating documents, and what is left is packed into
sequences. All but the last return the columns of ``documents``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import table
from riskloom.llm.exact_dedup import exact_dedup
from riskloom.llm.mixing import emit_copies, mix_sources
from riskloom.llm.packing import pack
from riskloom.llm.queries import tokenizer_path
from riskloom.llm.simhash import near_duplicates
from riskloom.llm.toxicity import score_toxicity
from riskloom.session import write_table


def _held(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and the whole row in one column that no result can clash with."""
    return docs.select(F.struct("*").alias("_whole"), *names)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    scored = score_toxicity(_held(docs, "doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.filter("predicted = 0").select("_whole.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the one with the largest doc_id."""
    return exact_dedup(_held(docs, "doc_id", "text"), carry=["_whole"]).filter("kept").select("_whole.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints of four-word shingles at four or fewer bits, the one with the smallest doc_id."""
    marked = near_duplicates(_held(docs, "doc_id", "text"), shingle=4, distance=4, carry=["_whole"])
    return marked.filter("kept").select("_whole.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    mixed = mix_sources(_held(docs, "doc_id", "text", "source")).select("_whole", "copies")
    return emit_copies(mixed).select("_whole.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack_sequences),
]

#: The toxicity model and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
