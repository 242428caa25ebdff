"""SimHash near-duplicates through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each padded to
the 23 bits of the perfect binary Golay code. The keys of a segment are the
indices of all codewords within distance four of it: one key, or six if the
nearest codeword is three away. Two segments that differ in at most one bit
always share a key: the nearest codeword of the one is at most four from the
other.

Pigeonhole over at most three wrong bits in three segments: either one segment
is exact and another has at most one error (six ordered pairs, keys
``exact + codeword index``), or each has one error (keys: the indices of the first
two and one error-free half of the third). Rows with equal keys are
joined by sorting and each pair's distance is verified.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, numbered, without, written

#: Bits of the three segments, and where each starts.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
MAX_BITS = 3
#: Generator polynomial of the (23, 12) Golay code, x^11+x^9+x^7+x^6+x^5+x+1.
GOLAY = 0b101011100011
#: Rows of one key that are compared in one task; larger buckets are compared in pairs of such blocks.
BLOCK = 4096
#: Shingles hashed before their bits are added up.
STEP = 1 << 16


def fingerprint(text: str | None, size: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles; 0 if no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    ones = np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, STEP):
        part = words[at : min(at + STEP, n) + size - 1]
        shingles = zip(*(part[k:] for k in range(size)), strict=False) if len(part) >= size else [part]
        hashes = np.array([digest(join(s), 42) for s in shingles], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _syndrome(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, np.int64).copy()
    for bit in range(22, 10, -1):
        v ^= ((v >> bit) & 1) * (GOLAY << (bit - 11))
    return v


class Golay:
    """Codewords within distance four, from syndromes."""

    def __init__(self):
        self.high = _syndrome(np.arange(4096) << 11)
        self.errors = np.full((2048, 6), -1, np.int64)
        for weight in range(4):
            patterns = np.array([sum(1 << b for b in c) for c in combinations(range(23), weight)])
            self.errors[_syndrome(patterns), 0] = patterns
        patterns = np.array([sum(1 << b for b in c) for c in combinations(range(23), 4)])
        coset = _syndrome(patterns)
        for s in np.unique(coset):
            if np.bitwise_count(self.errors[s, 0]) == 3:
                self.errors[s, 1:] = patterns[coset == s]

    def keys(self, v: np.ndarray) -> np.ndarray:
        """(n, 6) codeword indices; -1 fills up."""
        v = v.astype(np.int64)
        e = self.errors[self.high[v >> 11] ^ (v & 2047)]
        return np.where(e >= 0, (v[:, None] ^ e) >> 11, -1)


def bucket_keys(golay: Golay, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of each bucket that a fingerprint belongs to."""
    segs = [((fps >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    near = [golay.keys(s) for s in segs]
    rows, keys = [], []

    def put(kind: int, key: np.ndarray, ok: np.ndarray) -> None:
        at = np.nonzero(ok)
        rows.append(at[0])
        keys.append(key[at] | (kind << 40))

    kind = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                put(kind, (segs[i][:, None] << 12) | near[j], near[j] >= 0)
                kind += 1
    a, b = near[0][:, :, None], near[1][:, None, :]
    for half in (segs[2] >> 11, segs[2] & 2047):
        put(kind, (a << 24) | (b << 12) | half[:, None, None], (a >= 0) & (b >= 0))
        kind += 1
    return np.concatenate(rows), np.concatenate(keys)


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label = up


def _spanning(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a forest over rows, sorted by key, that share a key and differ in MAX_BITS at most."""
    label, at, lag, held = np.arange(len(key)), np.arange(len(key)), 1, []
    while len(at):
        at = at[at + lag < len(key)]
        at = at[key[at] == key[at + lag]]
        hit = at[np.bitwise_count(fp[at] ^ fp[at + lag]) <= MAX_BITS]
        if len(hit):
            held.append((hit, hit + lag))
        if held and (sum(len(x) for x, _ in held) > 200_000 or not len(at)):
            label = _union(label, *map(np.concatenate, zip(*held, strict=True)))
            held = []
        lag += 1
    child = np.nonzero(label != np.arange(len(key)))[0]
    return child, label[child]


LINKS = "u long, v long, key long, fp long, chunk int"


def _link_stream(batches, block: int):
    """Links within runs of one key; runs of over ``block`` rows are passed on in chunks."""

    names = [c.split()[0] for c in LINKS.split(", ")]

    def linked(key, fp):
        a, b = _spanning(key, fp.view(np.uint64))
        if n := len(a):
            yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b]), *(pa.nulls(n, pa.int64()) for _ in range(2)), pa.nulls(n, pa.int32())], names=names)

    def passed(key, fp, chunk):
        n = len(key)
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(key), pa.array(fp), pa.array(np.full(n, chunk, np.int32))], names=names)

    held = [np.zeros(0, np.int64)] * 2
    big, chunk = None, 0
    for batch in batches:
        held = [np.concatenate([h, batch.column(c).to_numpy(zero_copy_only=False)]) for h, c in zip(held, ("key", "fp"), strict=True)]
        if big is not None:  # rows of a run that is already too large
            n = int(np.searchsorted(held[0], big, "right"))
            for at in range(0, n, block):
                yield passed(*(h[at : min(n, at + block)] for h in held), chunk)
                chunk += 1
            held = [h[n:] for h in held]
            big = big if not len(held[0]) else None
        if not len(held[0]):
            continue
        last = int(np.searchsorted(held[0], held[0][-1], "left"))
        if len(held[0]) - last > block:
            big, chunk, n = held[0][-1], 0, len(held[0])
            for at in range(last, n, block):
                yield passed(*(h[at : at + block] for h in held), chunk)
                chunk += 1
        yield from linked(*(h[:last] for h in held))
        held = [h[len(h) if big is not None else last :] for h in held]
    if len(held[0]):
        yield from linked(*held)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """``doc_id``, ``fp`` (the 64 bits as a signed long) and ``more`` long columns of each row; null text counts as empty."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(x) for x in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]], names=["doc_id", "fp", *more])

    cols = [F.col(id_col).cast("long"), F.col(text_col).cast("string"), *(F.col(c).cast("long") for c in more)]
    return docs.select(*cols).mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *more)))


def groups_of(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """``fp``, ``grp`` of each distinct fingerprint: the least fingerprint (as a signed long) that its links reach."""
    classes = written(fps.select("fp").distinct(), "classes")

    def keyed(batches):
        golay = Golay()
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            row, key = bucket_keys(golay, fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], names=["key", "fp"])

    keys = classes.mapInArrow(keyed, "key long, fp long")
    links = written(
        keys.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _link_stream(it, block), LINKS), "links"
    )
    edges = links.where("u is not null").select("u", "v")
    over = links.where("key is not null")
    if not over.isEmpty():
        chunks = over.groupBy("key").agg(F.max("chunk").alias("last"))
        pairs = (
            over.join(chunks, "key")
            .select("key", "fp", "chunk", F.explode(F.sequence(F.lit(0), "last")).alias("other"))
            .select(F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("key"), "fp")
        )
        more = pairs.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _link_stream(it, 1 << 30), LINKS)
        edges = edges.unionByName(more.select("u", "v"))
    parts = connected_components(edges)
    return classes.join(parts, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("grp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Fingerprint and component of every document.

    Returns ``doc_id``, ``fingerprint`` (16 lowercase hex digits) and
    ``component_id``: the smallest id reachable over links of at most three
    differing bits, a document's own id included.

    Copies are one node: links run between distinct fingerprints. Null or empty
    texts have fingerprint zero and link like any other. Repeated rows are returned
    as often as given; a row without an id links like any other and gets its group's smallest id,
    or null if the group has none. Other columns, whatever their names, are not read. An
    empty table gives an empty result.
    """
    fps = written(fingerprints(docs, id_col, text_col), "fingerprints")
    grouped = written(groups_of(fps, block).join(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fp"), "grouped")
    least = grouped.groupBy("grp").agg(F.min("rep").alias("component_id"))
    named = written(grouped.join(least, "grp").select("fp", "component_id"), "groups")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group, the one with the smallest id.

    All columns are kept. Rows are told apart by a number of their own, never by their id: of rows that
    share the smallest id one stays, and a row that goes takes no namesake of another group along. Rows without an
    id come last; of a group that has no id one row stays. An empty table gives an empty result.
    """
    rows = numbered(docs)
    row, own = F.col("row"), "own"
    fps = written(fingerprints(rows.select("uid", row.getField(text_col).alias("t"), row.getField(id_col).alias(own)), own, "t", "uid"), "fingerprints")
    groups = written(groups_of(fps), "groups")
    # the order of ids, then of rows; null ids last
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "uid")
    of_fp = written(fps.groupBy("fp").agg(F.min(place).alias("first")).join(groups, "fp"), "firsts")
    stay = of_fp.groupBy("grp").agg(F.min("first").alias("first")).select("first.uid")
    return without(rows, fps.select("uid").join(stay, "uid", "left_anti"))
