"""Registration of all public names as SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .families import from_wire_json, implement, public_names, returns, to_wire_json
from .pb import _scalar
from .protojson import build_descriptor_set_batch, message_to_json_batch
from .udtf import show_wire_format, wire_json_as_table


def register_all(spark: SparkSession, like: str = "") -> int:
    """Register the 494 public names, or those that contain ``like``; returns how many."""
    made = 0
    for name, kind, family, t in public_names():
        if like in name:
            spark.udf.register(name, F.arrow_udf(_scalar(implement(kind, family, t)), returns(kind, family, t)))
            made += 1
    single = {
        "pb_message_to_wire_json": (to_wire_json, "string"),
        "pb_wire_json_to_message": (from_wire_json, "binary"),
        "pb_message_to_json": (message_to_json_batch, "string"),
        "pb_build_descriptor_set_json": (build_descriptor_set_batch, "string"),
    }
    for name, (f, kind) in single.items():
        if like in name:
            spark.udf.register(name, F.arrow_udf(_scalar(f), kind))
            made += 1
    for name, f in (("pb_wire_json_as_table", wire_json_as_table), ("pb_message_show_wire_format", show_wire_format)):
        if like in name:
            spark.udtf.register(name, f)
            made += 1
    for name, kind, value in (("pb_message_new", "BINARY", "X''"), ("pb_wire_json_new", "STRING", "'{}'")):
        if like in name:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}() RETURNS {kind} RETURN {value}")
            made += 1
    return made
