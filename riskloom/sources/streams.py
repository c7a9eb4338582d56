"""Streaming sources."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocabulary import EVENT_ALIASES

# Environment names that stand in for missing arguments.
KAFKA_DEFAULTS = {"subscribe": "KAFKA_TOPIC", "kafka.bootstrap.servers": "KAFKA_BOOTSTRAP_SERVERS"}


def kafka_options(topic: str | None = None, brokers: str | None = None, max_messages: int | None = None) -> dict[str, str]:
    """Reader options from explicit arguments, else from the environment; empty if a needed one is missing."""
    given = {"subscribe": topic, "kafka.bootstrap.servers": brokers}
    options = {name: given[name] or os.environ.get(variable, "") for name, variable in KAFKA_DEFAULTS.items()}
    if not all(options.values()):
        return {}
    limit = {} if max_messages is None else {"maxOffsetsPerTrigger": str(max_messages)}
    return {**options, "startingOffsets": "latest", **limit}


def kafka_source(spark: SparkSession, topic: str | None = None, brokers: str | None = None, max_messages: int | None = None) -> DataFrame | None:
    """Messages (offset, partition, value) of a topic from the latest offset; None when not configured.

    A trigger takes all that is there unless ``max_messages`` is given. The Kafka connector must be on the class path.
    """
    options = kafka_options(topic, brokers, max_messages)
    if not options:
        return None
    return spark.readStream.format("kafka").options(**options).load().select("offset", "partition", "value")


def read_messages(messages: DataFrame) -> DataFrame:
    """Messages (offset, partition, value), batch or stream, as event rows under the roles' first names, and what is wrong with them.

    A value is a JSON object whose keys are any accepted names of the roles, in any case, with blanks or hyphens for underscores. Of
    several names of one role the first accepted one counts, as for files; of equal keys the first. ``row_id`` is partition and offset,
    so a message read twice gives the same row. ``error`` is null for an event; else it says why the message is none (not an object, no
    user, no time, a time that cannot be read), and ``raw`` keeps its text. Roles that a message does not name are null.
    """
    raw = F.col("value").cast("string")
    read = messages.select(
        F.concat_ws("-", F.col("partition").cast("string"), F.col("offset").cast("string")).alias("row_id"), raw.alias("raw"),
        F.map_entries(F.from_json(raw, "map<string,string>")).alias("_cells"),
    )
    # Keys are brought to one form once a message. The row of one element keeps filters on what is read above the parsing: pushed below
    # it, they would parse every message again for each name they look up.
    normal = F.transform("_cells", lambda e: F.lower(F.translate(F.trim(e["key"]), " -", "__")))
    once = F.explode(F.array(F.struct(normal.alias("keys"), F.col("_cells.value").alias("values")))).alias("_message")
    read = read.select("row_id", "raw", once).select("row_id", "raw", F.col("_message.keys").alias("_keys"), F.col("_message.values").alias("_values"))

    def cell(aliases: tuple[str, ...]) -> Column:
        return F.coalesce(*[F.get("_values", F.array_position("_keys", alias).cast("int") - 1) for alias in aliases])

    roles = {aliases[0]: cell(aliases) for aliases in EVENT_ALIASES.values()}
    rows = read.select("row_id", "raw", F.col("_keys").isNull().alias("_broken"), *[c.alias(n) for n, c in roles.items()])
    time = F.try_to_timestamp("timestamp")
    error = (
        F.when(F.col("_broken"), "not a JSON object").when(F.col("user_id").isNull(), "no user")
        .when(F.col("timestamp").isNull(), "no time").when(time.isNull(), "unreadable time")
    )
    numbers = {c: F.col(c).try_cast("double") for c in ("data_volume_mb", "failed_attempts", "label")}
    return rows.withColumn("error", error).withColumns({"timestamp": time, **numbers}).drop("_broken")


def message_events(messages: DataFrame) -> DataFrame:
    """The events of :func:`read_messages`, ready for the event features; the label stays out where nothing gives one yet."""
    return read_messages(messages).filter("error is null").drop("error", "raw", "label")


def dead_letters(messages: DataFrame) -> DataFrame:
    """Messages that are no events: row_id, error, raw text."""
    return read_messages(messages).filter("error is not null").select("row_id", "error", "raw")


def parquet_stream(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """A folder of parquet files as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)
