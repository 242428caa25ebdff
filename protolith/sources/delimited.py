"""Files of length-delimited messages, the common ``.binpb`` stream layout, and descriptor sets."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.descriptors import Schema
from ..functions.types import WireError


def _split(data: bytes):
    pos = 0
    while pos < len(data):
        size = shift = 0
        while True:
            if pos >= len(data) or shift > 63:
                raise WireError("Unexpected end of BLOB")
            b = data[pos]
            pos += 1
            size |= (b & 127) << shift
            shift += 7
            if b < 128:
                break
        if pos + size > len(data):
            raise WireError("Unexpected end of BLOB")
        yield data[pos : pos + size]
        pos += size


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``position`` and ``message`` of every message of the files under ``path``. A file is read by one task."""

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held, k = [], 0
                for m in _split(content.as_py()):
                    held.append(m)
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_pydict({"path": [name] * len(held), "position": list(range(k, k + len(held))), "message": held})
                        k, held = k + len(held), []
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(held), pa.string()), pa.array(range(k, k + len(held)), pa.int64()), pa.array(held, pa.binary())], names=["path", "position", "message"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, position long, message binary")


def delimited(source) -> F.Column:
    """A message with its length before it, ready to be concatenated."""
    from ..functions import pb

    # field 1 of a message with the tag byte taken off is exactly the length and the payload
    framed = pb.build([(1, "message", F.col(source) if isinstance(source, str) else source)])
    return F.substring(framed, 2, 2147483647)


def read_schema(spark: SparkSession, path: str) -> Schema:
    """A schema from a binary descriptor set file, through Spark's readers."""
    row = spark.read.format("binaryFile").load(path).select("content").first()
    if row is None:
        raise FileNotFoundError(path)
    return Schema.from_descriptor_set(row.content)
