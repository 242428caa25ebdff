"""Vectorised wire-format kernels: one cursor per message, all messages of a batch in step."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view

from .types import I32, I64, LEN, VARINT, WireError

# Codes of what is wrong with a row; 0 is nothing.
OK, TRUNCATED, LONG_VARINT, WIRE_TYPE, FIELD_NUMBER, FIELD_TYPE, INDEX, RANGE, UTF8 = range(9)
MESSAGES = {
    TRUNCATED: "Unexpected end of BLOB",
    LONG_VARINT: "Varint is longer than 10 bytes",
    WIRE_TYPE: "Unsupported wire type",
    FIELD_NUMBER: "Invalid field number",
    FIELD_TYPE: "Unexpected wire type for the requested field",
    INDEX: "repeated index out of range",
    RANGE: "Value out of range",
    UTF8: "Invalid UTF-8 in string field",
}
MAX_FIELD = (1 << 29) - 1


def fail(bad: np.ndarray, index_text: str | None = None) -> None:
    """Raise the first row's error, if any."""
    if bad.any():
        row = int(np.flatnonzero(bad)[0])
        code = int(bad[row])
        raise WireError(index_text if code == INDEX and index_text else MESSAGES[code])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary array, slices and nulls included; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type)
    if not wide and not pa.types.is_binary(column.type):
        column = column.cast(pa.binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def spread(off: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions off[k] .. off[k] + length[k] - 1 of all k, one after another."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(off - (ends - length), length)


def slices(data: np.ndarray, off: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of slices, one after another; slices that already are so are not copied."""
    if len(off) and (off[1:] == off[:-1] + length[:-1]).all():
        return data[off[0] : off[-1] + length[-1]]
    return data[spread(off, length)]


def binary(data: np.ndarray, off: np.ndarray, length: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """A binary array of slices."""
    ends = np.zeros(len(off) + 1, np.int64)
    np.cumsum(length, out=ends[1:])
    if ends[-1] >= 1 << 31:
        raise WireError("a batch holds over 2 GB of messages; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    packed = slices(data, off, length) if ends[-1] else np.zeros(0, np.uint8)
    mask = None if valid is None or valid.all() else pa.array(valid).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(off), [mask, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(packed)])


def read_varints(data: np.ndarray, pos: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, position after it, code) of the varint at each position."""
    value, after, bad = np.zeros(len(pos), np.uint64), pos.copy(), np.zeros(len(pos), np.int8)
    live = np.arange(len(pos))
    for k in range(10):
        inside = after[live] < end[live]
        if not inside.all():
            bad[live[~inside]] = TRUNCATED
            live = live[inside]
        if not len(live):
            return value, after, bad
        b = data[after[live]]
        value[live] |= (b & 0x7F).astype(np.uint64) << np.uint64(7 * k)
        after[live] += 1
        live = live[b >= 128]
    bad[live] = LONG_VARINT
    return value, after, bad


def read_fixed(data: np.ndarray, pos: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bad = np.where(pos + size > end, TRUNCATED, OK).astype(np.int8)
    value = np.zeros(len(pos), np.uint64)
    ok = np.flatnonzero(bad == OK)
    value[ok] = get_fixed(data, pos[ok], size)
    return value, pos + size, bad


def get_fixed(data: np.ndarray, pos: np.ndarray, size: int) -> np.ndarray:
    if not len(pos):
        return np.zeros(0, np.uint64)
    return sliding_window_view(data, size)[pos].view(f"<u{size}").ravel().astype(np.uint64)


@dataclass
class Elements:
    """Wire elements of a batch of messages, by row and ordinal."""

    rows: int
    row: np.ndarray
    i: np.ndarray
    n: np.ndarray
    t: np.ndarray
    u: np.ndarray
    off: np.ndarray
    len: np.ndarray
    data: np.ndarray
    #: What was found out about these elements, which never change in place; others start with nothing.
    known: dict = field(default_factory=dict, init=False, repr=False, compare=False)

    def take(self, at: np.ndarray) -> Elements:
        return replace(self, **{k: getattr(self, k)[at] for k in ("row", "i", "n", "t", "u", "off", "len")})

    def next_i(self) -> np.ndarray:
        out = np.zeros(self.rows, np.int64)
        np.maximum.at(out, self.row, self.i + 1)
        return out

    def plus(self, row, i, n, t, u=None, payload: pa.Array | None = None) -> Elements:
        """With more elements; payloads are appended to the bytes. Sorted by row and ordinal."""
        m = len(row)
        u = np.zeros(m, np.uint64) if u is None else u
        off, length, data = np.zeros(m, np.int64), np.zeros(m, np.int64), self.data
        if payload is not None:
            raw, o = buffers(payload)
            off, length, data = o[:-1] + len(data), np.diff(o), np.concatenate([data, raw])
        join = lambda a, b: np.concatenate([a, np.broadcast_to(np.asarray(b, a.dtype), m)])
        e = Elements(self.rows, join(self.row, row), join(self.i, i), join(self.n, n), join(self.t, t), join(self.u, u), join(self.off, off), join(self.len, length), data)
        return e.take(np.lexsort((e.i, e.row)))


#: The column that was written last with its elements; the one that was read last with what was read, by field number.
_written: list = [None, None]
_read: list = [None, {}]


def parse(column: pa.Array, want: np.ndarray | None = None) -> tuple[Elements, np.ndarray]:
    """Elements of each message and a code per row. ``want``: a field number per row, others are skipped over.

    Functions of one column get the same array, and a chained function gets the very array that was written for it;
    neither is read again. The codes are the caller's own.
    """
    if want is not None and not (len(want) and (want == want[0]).all()):
        return _parse(column, want)
    if _written[0] is column:
        e = _written[1]
        all_ = want is None or (e.n == want[0]).all()
        return (e if all_ else e.take(np.flatnonzero(e.n == want[0]))), np.zeros(e.rows, np.int8)
    if _read[0] is not column:
        _read[:] = column, {}
    number = None if want is None else int(want[0])
    if number not in _read[1]:
        _read[1][number] = _parse(column, want)
    e, bad = _read[1][number]
    return e, bad.copy()


def _parse(column: pa.Array, want: np.ndarray | None) -> tuple[Elements, np.ndarray]:
    data, offsets = buffers(column)
    pos, end = offsets[:-1].copy(), offsets[1:]
    bad = np.zeros(len(pos), np.int8)
    found: list[tuple] = []
    live, step = np.flatnonzero(pos < end), 0
    while len(live):
        tag, p, code = read_varints(data, pos[live], end[live])
        n, t = (tag >> np.uint64(3)).astype(np.int64), (tag & np.uint64(7)).astype(np.int8)
        code[(code == OK) & ((n < 1) | (n > MAX_FIELD))] = FIELD_NUMBER
        code[(code == OK) & ((t == 3) | (t == 4) | (t > 5))] = WIRE_TYPE
        u, off, length = np.zeros(len(live), np.uint64), np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        for wire in (VARINT, LEN, I64, I32):
            at = np.flatnonzero((t == wire) & (code == OK))
            if not len(at):
                continue
            if wire in (VARINT, LEN):
                v, q, c = read_varints(data, p[at], end[live[at]])
            else:
                v, q, c = read_fixed(data, p[at], end[live[at]], 8 if wire == I64 else 4)
            if wire == LEN:
                room = (end[live[at]] - q).astype(np.uint64)
                c[(c == OK) & (v > room)] = TRUNCATED
                size = np.where(c == OK, v, 0).astype(np.int64)
                off[at], length[at] = q, size
                q = q + size
            else:
                u[at] = v
            p[at], code[at] = q, c
        bad[live] = code
        ok = code == OK
        keep = ok if want is None else ok & (n == want[live])
        found.append(tuple(x[keep] for x in (live, n, t, u, off, length)) + (np.full(int(keep.sum()), step, np.int64),))
        live, p = live[ok], p[ok]
        pos[live] = p
        live, step = live[p < end[live]], step + 1
    row, n, t, u, off, length, i = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, k) for k in (np.int64, np.int64, np.int8, np.uint64, np.int64, np.int64, np.int64))
    e = Elements(len(pos), row, i, n, t, u, off, length, data)
    return e.take(np.argsort(row, kind="stable")), bad


def varint_sizes(u: np.ndarray) -> np.ndarray:
    size = np.ones(len(u), np.int64)
    for k in range(1, 10):
        size += u >= np.uint64(1 << (7 * k))
    return size


def put_varints(out: np.ndarray, pos: np.ndarray, u: np.ndarray) -> None:
    live, rest = np.arange(len(u)), u.copy()
    k = 0
    while len(live):
        more = rest >= 128
        out[pos[live] + k] = (rest & np.uint64(0x7F)).astype(np.uint8) | np.where(more, 128, 0).astype(np.uint8)
        live, rest = live[more], rest[more] >> np.uint64(7)
        k += 1


def put_fixed(out: np.ndarray, pos: np.ndarray, u: np.ndarray, size: int) -> None:
    if len(pos):
        sliding_window_view(out, size, writeable=True)[pos] = _fixed(u, size).reshape(-1, size)


def _fixed(u: np.ndarray, size: int) -> np.ndarray:
    return u.astype(f"<u{size}").view(np.uint8)


def encode_values(wire: int, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, size of each) of values without tags."""
    if wire != VARINT:
        width = 8 if wire == I64 else 4
        return _fixed(u, width), np.full(len(u), width, np.int64)
    size = varint_sizes(u)
    ends = np.cumsum(size)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    put_varints(out, ends - size, u)
    return out, size


def serialise(e: Elements, valid: np.ndarray | None = None) -> pa.Array:
    """Messages with their elements by ordinal: a pass for sizes, then a pass that scatters."""
    tag = (e.n.astype(np.uint64) << np.uint64(3)) | e.t.astype(np.uint64)
    head = varint_sizes(tag)
    lead = np.where(e.t == VARINT, varint_sizes(e.u), np.where(e.t == LEN, varint_sizes(e.len.astype(np.uint64)), np.where(e.t == I64, 8, 4)))
    size = head + lead + np.where(e.t == LEN, e.len, 0)
    ends = np.cumsum(size)
    start = ends - size
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    put_varints(out, start, tag)
    for wire in (VARINT, I64, I32, LEN):
        at = np.flatnonzero(e.t == wire)
        if not len(at):
            continue
        p = start[at] + head[at]
        if wire == VARINT:
            put_varints(out, p, e.u[at])
        elif wire == LEN:
            put_varints(out, p, e.len[at].astype(np.uint64))
            out[spread(p + lead[at], e.len[at])] = slices(e.data, e.off[at], e.len[at])
        else:
            put_fixed(out, p, e.u[at], 8 if wire == I64 else 4)
    per_row = np.zeros(e.rows, np.int64)
    np.add.at(per_row, e.row, size)
    column = binary(out, np.cumsum(per_row) - per_row, per_row, valid)
    _written[:] = (column, _as_read(e)) if (valid is None or valid.all()) and _readable(e) else (None, None)
    return column


def _readable(e: Elements) -> bool:
    return bool(((e.n >= 1) & (e.n <= MAX_FIELD) & (e.t >= 0) & (e.t != 3) & (e.t != 4) & (e.t <= I32) & ((e.t != I32) | (e.u >> np.uint64(32) == 0))).all())


def _as_read(e: Elements) -> Elements:
    """The elements as they are read from what was written of them: numbered anew, with what the wire type has."""
    first = np.searchsorted(e.row, e.row)
    return replace(e, i=np.arange(len(e.row)) - first, u=np.where(e.t == LEN, np.uint64(0), e.u), off=np.where(e.t == LEN, e.off, 0), len=np.where(e.t == LEN, e.len, 0))


def logical(e: Elements, wire: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Logical elements of a field over unpacked and packed elements.

    Returns (element, place in it or -1 if it is not packed, bits, code per element). For LEN
    fields every element is one and its bits are unused.
    """
    bad = np.zeros(len(e.row), np.int8)
    if wire == LEN:
        bad[e.t != LEN] = FIELD_TYPE
        at = np.flatnonzero(e.t == LEN)
        return at, np.full(len(at), -1), np.zeros(len(at), np.uint64), bad
    bad[(e.t != wire) & (e.t != LEN)] = FIELD_TYPE
    single = np.flatnonzero(e.t == wire)
    found = [(single, np.full(len(single), -1), e.u[single])]
    if wire != VARINT:
        width = 8 if wire == I64 else 4
        run = np.flatnonzero((e.t == LEN) & (e.len > 0))
        count = e.len[run] // width
        bad[run[count * width < e.len[run]]] = TRUNCATED
        at = np.repeat(run, count)
        place = spread(np.zeros(len(run), np.int64), count)
        u = get_fixed(e.data, e.off[at] + place * width, width)
        if not len(single):
            return at, place, u, bad
        at, place, u = np.r_[single, at], np.r_[found[0][1], place], np.r_[found[0][2], u]
        order = np.lexsort((place, at))
        return at[order], place[order], u[order], bad
    live, pos, k = np.flatnonzero((e.t == LEN) & (e.len > 0)), e.off.copy(), 0
    end = e.off + e.len
    while len(live):
        v, q, c = read_varints(e.data, pos[live], end[live])
        bad[live] = c
        ok = c == OK
        live = live[ok]
        found.append((live, np.full(len(live), k), v[ok]))
        pos[live] = q[ok]
        live, k = live[pos[live] < end[live]], k + 1
    at, place, u = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((place, at))
    return at[order], place[order], u[order], bad
