"""Orders of events and the three operators that nearly every history table is made of."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

up, down = F.asc_nulls_last, F.desc_nulls_last


def first_arrival() -> list[Column]:
    return [up("load_datetime"), up("effective_from"), up("kafka_topic"), up("kafka_partition"), up("kafka_offset")]


def source_history() -> list[Column]:
    return [up("source_lsn"), up("effective_from"), up("kafka_partition"), up("kafka_offset"), up("source_event_id")]


def latest_state() -> list[Column]:
    return [down("source_lsn"), down("effective_from"), down("kafka_partition"), down("kafka_offset"), down("source_event_id")]


def latest_attributes() -> list[Column]:
    return [down("effective_from"), down("source_lsn"), down("kafka_partition"), down("kafka_offset"), down("source_event_id")]


def bronze_current() -> list[Column]:
    return [down("event_timestamp"), down("source_lsn"), down("kafka_offset")]


def top_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an order.  A rank of 1 lets Spark drop the others before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def changes_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], state: Column | str | Callable[..., Column], null_safe: bool = True, parts: Sequence[str] = ()) -> DataFrame:
    """The rows whose state differs from the row before them in the order (the first row of a key always does).

    With parts, state makes the compared value of these columns.  It is made after the rows have moved, so that a value
    that says the same as the columns (a hash, say) does not move with them.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    if parts:
        earlier = {f"_before_{c}": F.lag(c).over(w) for c in parts}
        now, before = state(*[F.col(c) for c in parts]), state(*[F.col(c) for c in earlier])
    else:
        now = F.col(state) if isinstance(state, str) else state
        earlier, before = {"_before": F.lag(now).over(w)}, F.col("_before")
    df = df.withColumns({"_n": F.row_number().over(w), **earlier})
    changed = ~now.eqNullSafe(before) if null_safe else now != before
    return df.filter((F.col("_n") == 1) | changed).drop("_n", *earlier)
