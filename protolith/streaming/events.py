"""Messages in Structured Streaming. Every function of ``pb`` is a stateless row function and works unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pb

#: The event message: 1 fixed64 id, 2 Timestamp, 3 sfixed32 user, 4 string type, 5 double value, 6 bytes props.
FIELDS = {"seconds": (1, "int64", 0), "nanos": (2, "int32", 0)}


def encode_events(events: DataFrame) -> DataFrame:
    """Messages of the ``events`` table, with the event time beside them for watermarks."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    stamp = pb.build([(1, "int64", F.floor(micros / 1_000_000).cast("bigint")), (2, "int32", (F.pmod(micros, F.lit(1_000_000)) * 1000).cast("int"))])
    return events.select(
        "ts",
        pb.build([(1, "fixed64", F.col("event_id").cast("decimal(20,0)")), (2, "message", stamp), (3, "sfixed32", F.col("user_id").cast("int")), (4, "string", "event_type"), (5, "double", "value"), (6, "bytes", F.col("props").cast("string").cast("binary"))]).alias("msg"),
    )


def decode_events(messages: DataFrame) -> DataFrame:
    got = pb.extract("msg", {"event_id": (1, "fixed64", 0), "at": (2, "message", b""), "user_id": (3, "sfixed32", 0), "event_type": (4, "string", ""), "value": (5, "double", 0.0)})
    rows = messages.select(got.alias("e")).select("e.*")
    time = pb.extract("at", FIELDS)
    return rows.withColumn("t", time).select(
        F.col("event_id").cast("bigint").alias("event_id"),
        F.timestamp_micros(F.col("t.seconds") * 1_000_000 + F.floor(F.col("t.nanos") / 1000)).alias("ts"),
        F.col("user_id").cast("bigint").alias("user_id"),
        "event_type",
        "value",
    )


def windowed(events: DataFrame, length: str = "1 hour", delay: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums per window and type, for batches and for streams with late rows up to ``delay``."""
    frame = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (
        events.withWatermark("ts", delay)
        .groupBy(frame.alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Events of a user with pauses shorter than ``gap`` as sessions, for batches and for streams."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count("*").alias("n"))
        .select("user_id", F.col("w.start").alias("start"), "n")
    )
