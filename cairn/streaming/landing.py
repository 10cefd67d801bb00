"""Landing of change events: validation and normalisation as column expressions, an idempotent sink, Structured Streaming.

The sink writes each event once under its coordinates; the same event again is dropped, other content under the same
identity raises.  With a checkpointed query that is effectively once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from cairn.sources.schemas import ENVELOPE

#: What a broker's source gives: raw key and value with their coordinates.
RECORD = "topic string, partition int, offset bigint, timestamp timestamp, key binary, value binary"
_VALUE = "struct<before:string, after:string, op:string, source:struct<schema:string, table:string, ts_ms:bigint, lsn:bigint, txId:bigint>, transaction:struct<id:string, total_order:bigint>>"
_SAFE = r"^[A-Za-z0-9_.-]+$"


#: An envelope and the folders that it lands in.
LANDED = StructType([*ENVELOPE.fields, *(StructField(c, StringType()) for c in ("schema", "table", "event_date"))])


class InvalidRecord(RuntimeError):
    """A record breaks the envelope's contract."""


class IdentityConflict(RuntimeError):
    """An event with other content is already landed under the same identity."""


def _iso(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def normalize(records: DataFrame, source_system: str = "core_banking", group: str = "cairn", schemas: Sequence[str] = ("prm", "mms", "krd")) -> DataFrame:
    """Envelope columns (_metadata, key, value) and `problem`, the first breach of the contract or null."""
    raw = F.col("value").cast("string")
    key = F.col("key").cast("string")
    body = F.when(F.col("value").isNotNull(), F.coalesce(F.get_json_object(raw, "$.payload"), raw))
    r = records.withColumns({"_key": F.coalesce(F.get_json_object(key, "$.payload"), key), "_body": body})
    r = r.withColumn("_v", F.from_json("_body", _VALUE, {"mode": "PERMISSIVE"}))
    parts = F.split("topic", r"\.")
    r = r.withColumns({
        "_op": F.when(F.col("value").isNull(), "tombstone").otherwise(F.col("_v.op")),
        "_schema": F.lower(F.coalesce(F.col("_v.source.schema"), F.try_element_at(parts, F.lit(-2)))),
        "_table": F.lower(F.coalesce(F.col("_v.source.table"), F.try_element_at(parts, F.lit(-1)))),
        "_ms": F.when(F.unix_millis("timestamp") >= 0, F.unix_millis("timestamp")),
    })
    r = r.withColumns({
        "_id": F.sha2(F.concat_ws(":", "topic", "partition", "offset"), 256),
        "_sha": F.sha2(F.concat(F.coalesce("key", F.lit(b"")), F.lit(b"\0"), F.coalesce("value", F.lit(b""))), 256),
        "_at": F.coalesce(F.col("_v.source.ts_ms"), F.col("_ms"), F.lit(0).cast("long")),
    })
    path = F.format_string(
        "bronze/cdc/source=%s/schema=%s/table=%s/event_date=%s/topic=%s/partition=%d/offset=%020d.json",
        F.lit(source_system), "_schema", "_table", F.date_format(F.timestamp_millis("_at"), "yyyy-MM-dd"), "topic", "partition", "offset",
    )
    complete = F.coalesce(F.json_object_keys("_body"), F.array().cast("array<string>"))
    problem = (
        F.when(F.col("value").isNotNull() & (F.get_json_object("_body", "$").isNull() | ~F.trim("_body").startswith("{")), "value is no JSON object")
        .when(F.col("key").isNotNull() & F.get_json_object("_key", "$").isNull(), "key is no JSON")
        .when(F.col("value").isNotNull() & ~(F.array_contains(complete, "op") & F.array_contains(complete, "source") & (F.array_contains(complete, "after") | F.array_contains(complete, "before"))), "envelope is incomplete")
        .when(F.coalesce(F.col("_op"), F.lit("")).isin("r", "c", "u", "d", "tombstone") == F.lit(False), "operation is unknown")
        .when(~F.coalesce(F.col("_schema").rlike(_SAFE) & F.col("_table").rlike(_SAFE) & F.col("topic").rlike(_SAFE), F.lit(False)), "name is unsafe in a path")
        .when(~F.col("_schema").isin(*schemas), "schema is not allowed")
    )
    meta = F.struct(
        F.col("_id").alias("event_id"), F.lit(source_system).alias("source_system"), F.col("_schema").alias("source_schema"), F.col("_table").alias("source_table"), F.col("_op").alias("operation"),
        F.col("topic").alias("kafka_topic"), F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset"), F.col("_ms").alias("kafka_timestamp_ms"), _iso(F.col("_at")).alias("event_timestamp"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ingested_at"), F.col("_sha").alias("payload_sha256"), F.lit(group).alias("consumer_group"), path.alias("object_key"),
    )
    return r.select(meta.alias("_metadata"), F.col("_key").alias("key"), F.when(F.col("value").isNotNull(), F.col("_v")).alias("value"), problem.alias("problem"))


def land(events: DataFrame, root: str) -> int:
    """Append the events that are not landed yet; returns how many were new.  Invalid records stop the whole batch."""
    spark = events.sparkSession
    bad = events.filter("problem is not null").select("problem", "_metadata.kafka_topic", "_metadata.kafka_partition", "_metadata.kafka_offset").head()
    if bad:
        raise InvalidRecord(f"{bad['problem']}: {bad['kafka_topic']}:{bad['kafka_partition']}:{bad['kafka_offset']}")
    fresh = events.drop("problem").withColumns({"_id": F.col("_metadata.event_id"), "_sha": F.col("_metadata.payload_sha256")})
    twice = fresh.groupBy("_id").agg(F.count_distinct("_sha").alias("n")).filter("n > 1")
    if not twice.isEmpty():
        raise IdentityConflict("records of one batch share an identity and differ")
    fresh = fresh.dropDuplicates(["_id"])
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        # an event lands in the folder of its table and date: only the folders that this batch touches are read
        day = F.substring("_metadata.event_timestamp", 1, 10)
        touched = fresh.groupBy(F.col("_metadata.source_schema").alias("schema"), F.col("_metadata.source_table").alias("table")).agg(F.min(day).alias("low"), F.max(day).alias("high")).collect()  # a row a table
        folders = reduce(or_, [(F.col("schema") == t["schema"]) & (F.col("table") == t["table"]) & F.col("event_date").between(t["low"], t["high"]) for t in touched], F.lit(False))
        landed = spark.read.schema(LANDED).json(root).filter(folders).select(F.col("_metadata.event_id").alias("_id"), F.col("_metadata.payload_sha256").alias("_old"))
        both = fresh.join(landed, "_id")
        if not both.filter("_sha <> _old").isEmpty():
            raise IdentityConflict("a landed event has the same identity and other content")
        fresh = fresh.join(landed, "_id", "left_anti")
    m = F.col("_metadata")
    out = fresh.withColumns({"schema": m["source_schema"], "table": m["source_table"], "event_date": F.substring(m["event_timestamp"], 1, 10)}).drop("_id", "_sha")
    observed = out.cache()
    try:
        new = observed.count()
        if new:
            observed.write.partitionBy("schema", "table", "event_date").mode("append").json(root)
        return new
    finally:
        observed.unpersist()


def read_topics(spark: SparkSession, servers: str, pattern: str) -> DataFrame:
    """The broker's stream (needs the Kafka package on the class path)."""
    options = {"kafka.bootstrap.servers": servers, "subscribePattern": pattern, "startingOffsets": "earliest"}
    return spark.readStream.format("kafka").options(**options).load().select("topic", "partition", "offset", "timestamp", "key", "value")


def read_record_files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of Parquet files of records, for replays and tests."""
    return spark.readStream.schema(RECORD).parquet(path)


def start_landing(records: DataFrame, root: str, checkpoint: str, available_now: bool = True, **options) -> StreamingQuery:
    writer = records.writeStream.foreachBatch(lambda df, _: land(normalize(df, **options), root)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def consumer_lag(high: DataFrame, committed: DataFrame) -> DataFrame:
    """Lag of each partition and topic: high mark less committed offset, never below 0."""
    both = high.join(committed, ["topic", "partition"], "left")
    return both.select("topic", "partition", F.greatest(F.col("high") - F.coalesce("committed", F.lit(0)), F.lit(0)).alias("lag"))
