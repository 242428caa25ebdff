"""Best-fit packing with Martello-Toth dominance reduction.

Only the histogram of piece lengths decides a packing: at most ``capacity``
counts reach the driver, whatever the corpus. There, bins that provably dominate
every alternative are fixed, best-fit decreasing packs what is left, and both give
*runs*: the n-th piece of a length belongs to a bin and an offset that follow from n by
arithmetic. Executors number the pieces of each length and look their places up.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .tokenize import encoder

CAPACITY = 2048
Bins = list[tuple[tuple[tuple[int, int], ...], int]]  # (((length, how many), ...), how many bins)


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[Bins, dict[int, int]]:
    """Bins that an optimal packing may contain, fixed, and the counts that remain.

    For the largest piece j with room r left beside it, a set dominates if each
    other feasible companion set can be cut into parts that fit into its pieces:

    * no piece fits beside j: j alone;
    * a piece of exactly r exists: that piece;
    * no two others fit together: the largest that fits;
    * no three others fit together: the largest that fits, if it is as large as every
      fitting pair; or it with the largest that still fits, if no fitting pair has a larger
      second piece.
    """
    left, fixed = Counter({k: v for k, v in counts.items() if v > 0}), []

    def fix(*pieces: int) -> None:
        need = Counter(pieces)
        times = min(left[k] // n for k, n in need.items())
        fixed.append((tuple(sorted(need.items(), reverse=True)), times))
        for k, n in need.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]

    def companions(j: int, room: int) -> tuple[int, ...] | None:
        """The dominating companions of j, or None if none is proven."""
        sizes = [k for k in order if k <= room and left[k] - (k == j) > 0]
        if not sizes:
            return ()
        top = sizes[-1]
        if top == room:
            return (top,)
        small = []
        for k in sizes[:3]:
            small += [k] * min(3, left[k] - (k == j))
        if sum(small[:2]) > room or len(small) == 1:
            return (top,)
        if sum(small[:3]) <= room and len(small) > 2:
            return None
        best, second, has = 0, 0, lambda a, b: left[a] - (a == j) >= 1 + (a == b)
        for s in sizes:  # s is the smaller piece of a pair
            k = bisect_right(sizes, room - s) - 1
            while k >= 0 and sizes[k] >= s and not has(sizes[k], s):
                k -= 1
            if k >= 0 and sizes[k] >= s:
                best, second = max(best, sizes[k] + s), max(second, s)
        if top >= best:
            return (top,)
        k = bisect_right(sizes, room - top) - 1
        while k >= 0 and not has(top, sizes[k]):
            k -= 1
        return (top, sizes[k]) if k >= 0 and second <= sizes[k] else None

    moved = True
    while moved:
        moved = False
        for j in sorted(left, reverse=True):
            while left.get(j):
                order = sorted(left)
                if (found := companions(j, capacity - j)) is None:
                    break
                fix(j, *found)
                moved = True
    return fixed, dict(left)


def best_fit(counts: dict[int, int], capacity: int) -> Bins:
    """Best-fit decreasing over a histogram; equal bins are moved together."""
    open_: dict[int, list[list]] = defaultdict(list)  # room left -> [pattern, bins]
    rooms: list[int] = []
    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            rooms = sorted(r for r, groups in open_.items() if groups)
            at = bisect_right(rooms, size - 1)
            room = rooms[at] if at < len(rooms) else capacity
            groups = open_[room] if at < len(rooms) else [[(), n]]
            pattern, bins = groups.pop()
            each = room // size
            full = min(bins, n // each)
            if full:
                open_[room - each * size].append([(*pattern, (size, each)), full])
            n -= full * each
            rest = bins - full if at < len(rooms) else bool(n)
            if rest and n:  # one more bin takes what is left
                open_[room - n * size].append([(*pattern, (size, n)), 1])
                rest, n = rest - 1, 0
            if rest and at < len(rooms):
                open_[room].append([pattern, rest])
    return [(p, b) for groups in open_.values() for p, b in groups]


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> Bins:
    fixed, left = reduce_dominated(counts, capacity)
    return fixed + best_fit(left, capacity)


class Places:
    """Bin and offset of the n-th piece of a length."""

    def __init__(self, bins: Bins):
        taken, rows, first = Counter(), [], 0
        for pattern, times in bins:
            offset = 0
            for size, each in pattern:
                rows.append((size, taken[size], each, first, offset))
                taken[size] += each * times
                offset += size * each
            first += times
        self.bins = first
        self.rows = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.key = (self.rows[:, 0] << 45) | self.rows[:, 1]

    def find(self, length: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 45) | nth, "right") - 1
        size, start, each, first, offset = self.rows[at].T
        k = nth - start
        return first + k // each, offset + k % each * size


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """Token pieces of each document, with ``part`` and ``nth``: the input partition and the number among its pieces of that length."""

    def run(batches):
        encode, seen = encoder(tokenizer).encode, Counter()
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            part, out = b.column(2), []
            for doc, text, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), part.to_pylist(), strict=True):
                ids = encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    n = len(cut) // 4
                    out.append((doc, k, at // 4, n, zlib.crc32(cut), p, seen[n], *((cut,) if with_ids else ())))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"] + ["ids"] * with_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * with_ids
    schema = PIECE + ", part int, nth long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.spark_partition_id()).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Documents packed into sequences of at most ``capacity`` tokens.

    Returns a row per piece: ``doc_id``, ``piece``, ``start`` (tokens of its document before
    it), ``length``, ``ids_crc32``, ``sequence_id`` and ``offset``; with ``with_ids`` also the
    ids as little-endian unsigned 32-bit bytes. A null or empty text is the end
    token alone. Repeated rows are packed as often as given, a null id is passed on,
    other columns are not read, and an empty table gives an empty result.
    """
    cut = written(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids), "pieces")
    parts = written(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    bins = pack_histogram({r.length: r.n for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    places = Places(bins)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = parts.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    keep = [c for c in cut.columns if c not in ("part", "nth")]

    def place(batches):
        for b in batches:
            bin_, offset = places.find(b.column("length").to_numpy(zero_copy_only=False), b.column("nth").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(bin_), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    numbered = cut.join(base, ["part", "length"]).select(*keep, (F.col("nth") + F.col("base")).alias("nth"))
    return numbered.mapInArrow(place, PIECE + ", ids binary" * with_ids + ", sequence_id long, offset long")
