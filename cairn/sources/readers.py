"""Scans: JSON lines, change events (whole history or exact objects), object listings, JDBC counts."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources.schemas import ENVELOPE, SOURCE_TABLES

#: Where an event's coordinates stand in its object key (a fixed format).
COORDINATES = re.compile(r"topic=(?P<topic>[^/]+)/partition=(?P<partition>\d+)/offset=(?P<offset>\d+)\.json$")


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table of JSON lines; without a schema it is inferred."""
    reader = spark.read.option("multiLine", "false").option("pathGlobFilter", "*.jsonl")
    return (reader.schema(schema) if schema else reader).json(path)


def read_events(spark: SparkSession, root: str, bounds: DataFrame | None = None) -> DataFrame:
    """All landed events below a folder; bounds (topic, partition, high) keep offsets up to each high mark."""
    events = spark.read.schema(ENVELOPE).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(root)
    if bounds is None:
        return events
    m = lambda f: F.col(f"_metadata.{f}")
    cond = (m("kafka_topic") == F.col("topic")) & (m("kafka_partition") == F.col("partition")) & (m("kafka_offset") <= F.col("high"))
    return events.join(bounds, cond, "left_semi")


def read_bounded_events(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Exactly the listed objects; an empty list is an error, as a batch without input needs no scan."""
    if not paths:
        raise ValueError("a bounded scan needs at least one object")
    return spark.read.schema(ENVELOPE).json(list(paths))


def up_to(marks: Iterable[tuple[str, int, int]], topic: str = "_metadata.kafka_topic", partition: str = "_metadata.kafka_partition", offset: str = "_metadata.kafka_offset") -> Column:
    """The predicate for a short list of (topic, partition, high)."""
    return reduce(or_, [(F.col(topic) == t) & (F.col(partition) == p) & (F.col(offset) <= h) for t, p, h in marks], F.lit(False))


def list_objects(spark: SparkSession, root: str) -> DataFrame:
    """object_key, size_bytes, topic, partition and offset of every object whose name has coordinates; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(root).select("path", "length")
    pattern = r"topic=([^/]+)/partition=(\d+)/offset=(\d+)\.json$"
    part = lambda i: F.regexp_extract("path", pattern, i)
    return files.filter(F.col("path").rlike(pattern)).select(
        F.col("path").alias("object_key"), F.col("length").alias("size_bytes"), part(1).alias("topic"), part(2).cast("int").alias("partition"), part(3).cast("long").alias("offset")
    )


def duplicate_coordinates(objects: DataFrame) -> DataFrame:
    return objects.groupBy("topic", "partition", "offset").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def jdbc_count_query(tables: Sequence[str] = SOURCE_TABLES) -> str:
    return " UNION ALL ".join(f"SELECT '{t}' AS object_name, CAST(COUNT(*) AS BIGINT) AS source_count FROM {t}" for t in tables)


def read_source_counts(spark: SparkSession, url: str, user: str, password: str, driver: str, tables: Sequence[str] = SOURCE_TABLES) -> DataFrame:
    """Row counts of the source tables, counted by the source itself (the driver's jar must be on the class path)."""
    options = {"url": url, "query": jdbc_count_query(tables), "user": user, "password": password, "driver": driver}
    return spark.read.format("jdbc").options(**options).load()


def source_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """The same counts for tables that are DataFrames."""
    parts = [df.agg(F.count(F.lit(1)).alias("source_count")).select(F.lit(name).alias("object_name"), "source_count") for name, df in frames.items()]
    return reduce(DataFrame.unionAll, parts)


def describe_columns(df: DataFrame) -> list[tuple[int, str, str]]:
    """(ordinal from 1, name, type) of a frame's columns."""
    return [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields, 1)]
