"""Token ids as flat binary files with 64-bit document offsets.

A corpus is a folder of parts. Part k has ``k.bin`` (ids as unsigned little-endian
integers, 16 bits if the vocabulary allows it, else 32), ``k.off`` (int64: where each
document starts in the part, and the end) and ``k.id`` (int64 document ids; the least
int64 stands for null). ``manifest.json`` lists documents and tokens of each part
and the tokens before it, a prefix sum, so that a document's global place is
``base + offset`` and every part can be memory-mapped by itself.

A task writes under a name of its own and renames when all is written, so
repeated or lost attempts leave no half files.
"""

from __future__ import annotations

import json
import math
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir
from .tokenize import encoder

NO_ID = -(1 << 63)
#: Bytes of input for each part; documents and tokens that are read back at once (a longer document by itself).
PART_BYTES, READ_DOCS, READ_TOKENS = 128 << 20, 10_000, 4 << 20


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def _put(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    own = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        f.write(data)
    fs.move(own, path)


def _parts(docs: DataFrame) -> int:
    """As many parts as ``PART_BYTES`` of the input's known size ask for, and at least Spark's own number."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, math.ceil(size / PART_BYTES)) if size < 1 << 60 else least  # beyond that, Spark does not know


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> list[dict]:
    """Write ``docs`` in ascending id order under ``folder``, in ``parts`` parts (by default from the input's size); returns the manifest's parts.

    Ids repeated across rows are all written, in the order of their texts' hashes. Null ids come
    first; a null text is empty; each document ends with ``end_id``. Only one small row per
    part reaches the driver. Other columns are not read; an empty table gives a corpus without parts.
    """
    uri = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"
    fs, root = _open(uri)
    fs.create_dir(root, recursive=True)

    def run(batches):
        out, root = _open(uri)
        e = encoder(tokenizer)
        kind = "<u2" if max(e.vocab_size, end_id + 1) <= 1 << 16 else "<u4"
        end, own = np.array([end_id], kind).tobytes(), uuid.uuid4().hex
        part, ids, offsets, at, stream = None, array("q"), array("q", [0]), 0, None
        for b in batches:
            if not b.num_rows:
                continue
            if stream is None:
                part = b.column(2)[0].as_py()
                stream = out.open_output_stream(f"{root}/{part:06d}.bin.{own}")
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = e.encode(text or "")
                data = data if kind == "<u4" else np.frombuffer(data, "<u4").astype(kind).tobytes()
                stream.write(data + end)
                at += len(data) // int(kind[2]) + 1
                ids.append(NO_ID if doc is None else doc)
                offsets.append(at)
        if stream is not None:
            stream.close()
            out.move(f"{root}/{part:06d}.bin.{own}", f"{root}/{part:06d}.bin")
            _put(out, f"{root}/{part:06d}.off", np.asarray(offsets, "<i8").tobytes())
            _put(out, f"{root}/{part:06d}.id", np.asarray(ids, "<i8").tobytes())
            yield pa.RecordBatch.from_pydict({"part": [part], "docs": [len(ids)], "tokens": [at], "kind": [kind]})

    ordered = (
        docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("t"))
        .repartitionByRange(parts or _parts(docs), "d", F.xxhash64("t"))
        .sortWithinPartitions("d", F.xxhash64("t"))
        .select("d", "t", F.spark_partition_id().cast("long"))
    )
    made = sorted((r.asDict() for r in ordered.mapInArrow(run, "part long, docs long, tokens long, kind string").collect()), key=lambda r: r["part"])
    base = first = 0
    for p in made:
        p |= {"base": base, "first": first}
        base, first = base + p["tokens"], first + p["docs"]
    _put(fs, f"{root}/manifest.json", json.dumps({"end_id": end_id, "parts": made}).encode())
    return made


class TokenPart:
    """One part, memory-mapped where the file system is local; elsewhere ranges of it are read."""

    def __init__(self, folder: str, part: int, kind: str):
        self.fs, self.root = _open(folder)
        self.name, self.kind = f"{self.root}/{part:06d}", kind
        self.local = isinstance(self.fs, pafs.LocalFileSystem)
        self.files = {x: np.memmap(f"{self.name}.{x}", self._kind(x), "r") if self.local else self.fs.open_input_file(f"{self.name}.{x}") for x in ("off", "id", "bin")}

    def _kind(self, suffix: str) -> np.dtype:
        return np.dtype(self.kind if suffix == "bin" else "<i8")

    def _range(self, suffix: str, a: int, b: int) -> np.ndarray:
        if self.local:
            return np.asarray(self.files[suffix][a:b])
        size = self._kind(suffix).itemsize
        return np.frombuffer(self.files[suffix].read_at((b - a) * size, a * size), self._kind(suffix))

    def __len__(self) -> int:
        return len(self.files["id"]) if self.local else self.files["id"].size() // 8

    def read(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Document ids, offsets (one more) and the tokens of documents ``a`` to ``b``."""
        off = self._range("off", a, b + 1)
        tokens = self._range("bin", int(off[0]), int(off[-1]))
        return self._range("id", a, b), off, [tokens[x:y] for x, y in zip(off - off[0], off[1:] - off[0], strict=False)]

    def batches(self):
        """``read`` of slices of bounded size."""
        at = 0
        while at < len(self):
            off = self._range("off", at, min(at + READ_DOCS, len(self)) + 1)
            n = max(1, int(np.searchsorted(off, off[0] + READ_TOKENS, "right")) - 1)
            yield self.read(at, at + n)
            at += n

    def __getitem__(self, k: int) -> np.ndarray:
        return self.read(k, k + 1)[2][0]


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Documents of a written corpus: ``doc_id``, ``start`` (tokens before it in the whole corpus), ``n_tokens``, ``ids_crc32``; with ``with_ids`` also ``ids``."""
    uri = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"
    fs, root = _open(uri)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        parts = json.loads(f.read())["parts"]
    rows = [(p["part"], p["base"], p["kind"]) for p in parts]

    def run(batches):
        for b in batches:
            for part, base, kind in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held = TokenPart(uri, part, kind)
                for doc, off, ids in held.batches():
                    ids = [x.astype("<u4") for x in ids]
                    cols = [pa.array(doc, mask=doc == NO_ID), pa.array(off[:-1] + base), pa.array(np.diff(off)), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())]
                    cols += [pa.array([x.astype("i8").tolist() for x in ids], pa.list_(pa.int64()))] * with_ids
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    listed = spark.createDataFrame(rows, "part long, base long, kind string").repartition(max(1, len(rows)))
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def corpus_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/protolith/tokens-{uuid.uuid4().hex}"
