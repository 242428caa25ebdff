"""Reading and editing fields of parsed batches. Every public family is one of these on all seventeen types.

All take ``(e, bad)``, the elements of a batch and a code per row, and field numbers
``n`` per row. A batch comes from messages or from wire JSON; the edits keep ordinals, so
both representations go through the same code.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import wire as W
from .types import LEN, ProtoType, WireError, from_bytes, null_where, to_bytes, valid_utf8
from .wire import Elements

BOUNDS = "Index out of bounds"


def _field(e: Elements, n: np.ndarray) -> np.ndarray:
    return np.flatnonzero(e.n == n[e.row])


def _mark(bad: np.ndarray, rows: np.ndarray, codes: np.ndarray) -> None:
    for code in np.unique(codes[codes != W.OK]):
        at = rows[codes == code]
        bad[at] = np.where(bad[at] == W.OK, code, bad[at])


def _values(t: ProtoType, e: Elements, at: np.ndarray, u: np.ndarray, rows: np.ndarray, bad: np.ndarray) -> pa.Array:
    """Typed values of elements ``at`` with bits ``u``; rows with a value that the type cannot hold are marked."""
    if t.wire == LEN:
        raw = W.binary(e.data, e.off[at], e.len[at])
        if t.name == "string" and not (ok := valid_utf8(raw)).all():
            _mark(bad, rows, np.where(ok, W.OK, W.UTF8))
            raw = null_where(raw, ~ok)
        return from_bytes(t, raw)
    over = t.out_of_range(u)
    if over.any():
        _mark(bad, rows, np.where(over, W.RANGE, W.OK))
        u = np.where(over, np.uint64(0), u)
    return t.decode(u)


def _pick(values: pa.Array, rank: np.ndarray, has: np.ndarray, default: pa.Array | None) -> pa.Array:
    """values[rank] where has, else the row's default."""
    default = pa.nulls(len(has), values.type) if default is None else default.cast(values.type)
    at = np.where(has, rank, len(values) + np.arange(len(has)))
    return pa.concat_arrays([values, default]).take(pa.array(at))


def _single(t: ProtoType, e: Elements, bad: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(last element of each row's field or -1, its elements)."""
    at = _field(e, n)
    _mark(bad, e.row[at], np.where(e.t[at] != t.wire, W.FIELD_TYPE, W.OK))
    last = np.full(e.rows, -1)
    last[e.row[at]] = at  # elements are in order, so the last stays
    return last, at


def get(t: ProtoType, e: Elements, bad: np.ndarray, n: np.ndarray, default: pa.Array | None) -> pa.Array:
    last, _ = _single(t, e, bad, n)
    rows = np.flatnonzero((last >= 0) & (bad == W.OK))
    values = _values(t, e, last[rows], e.u[last[rows]], rows, bad)
    rank = np.zeros(e.rows, np.int64)
    rank[rows] = np.arange(len(rows))
    has = np.zeros(e.rows, bool)
    has[rows] = True
    return _pick(values, rank, has, default)


def has(t: ProtoType, e: Elements, bad: np.ndarray, n: np.ndarray) -> pa.Array:
    return pa.array(_single(t, e, bad, n)[0] >= 0)


def _logical(t: ProtoType, e: Elements, bad: np.ndarray, n: np.ndarray):
    """(elements of the fields, positions among them, place if packed, bits, row of each value, count per row)."""
    key = (t.wire, int(n[0])) if len(n) and (n == n[0]).all() else None
    if key is None or key not in e.known:
        at = _field(e, n)
        own = e.take(at)
        which, place, u, codes = W.logical(own, t.wire)
        row = own.row[which]
        found = (at, at[which], place, u, row, np.bincount(row, minlength=e.rows)), own.row, codes
        if key is not None:
            e.known[key] = found
    else:
        found = e.known[key]
    out, rows, codes = found
    _mark(bad, rows, codes)
    return out


def count(t: ProtoType, e: Elements, bad: np.ndarray, n: np.ndarray) -> pa.Array:
    return pa.array(_logical(t, e, bad, n)[-1].astype(np.int32))


def element(t: ProtoType, e: Elements, bad: np.ndarray, n: np.ndarray, k: np.ndarray) -> pa.Array:
    """The k-th logical element; -1 gives null, anything else outside is an error."""
    _, el, _, u, row, size = _logical(t, e, bad, n)
    _mark(bad, np.arange(e.rows), np.where((k < -1) | (k >= size), W.INDEX, W.OK))
    first = np.cumsum(size) - size
    rows = np.flatnonzero((k >= 0) & (bad == W.OK))
    at = first[rows] + k[rows]
    values = _values(t, e, el[at], u[at], rows, bad)
    rank, there = np.zeros(e.rows, np.int64), np.zeros(e.rows, bool)
    rank[rows], there[rows] = np.arange(len(rows)), True
    return _pick(values, rank, there, None)


def repeated(t: ProtoType, e: Elements, bad: np.ndarray, n: np.ndarray) -> pa.Array:
    """All logical elements as a list per row."""
    _, el, _, u, row, size = _logical(t, e, bad, n)
    values = _values(t, e, el, u, row, bad)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), values)


# ---- edits: each returns new elements


def clear(e: Elements, n: np.ndarray) -> Elements:
    return e.take(np.flatnonzero(e.n != n[e.row]))


def _encode(t: ProtoType, values: pa.Array) -> tuple[np.ndarray | None, pa.Array | None]:
    return (None, to_bytes(t, values)) if t.wire == LEN else (t.bits(values), None)


def set_(t: ProtoType, e: Elements, n: np.ndarray, values: pa.Array) -> Elements:
    """All occurrences go; one comes at the end, with the next ordinal of the message as it was."""
    u, payload = _encode(t, values)
    return clear(e, n).plus(np.arange(e.rows), e.next_i(), n, t.wire, u, payload)


def _flat(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all elements, how many per row) of a list array; a null list is empty."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    sizes = np.asarray(values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    return values.flatten(), sizes


def _with_payload(e: Elements, at: np.ndarray, raw: np.ndarray, off: np.ndarray, size: np.ndarray) -> Elements:
    """Elements ``at`` with payloads that are slices of ``raw``, appended to the bytes."""
    new = e.take(np.arange(len(e.row)))
    new.off[at], new.len[at] = off + len(e.data), size
    new.data = np.concatenate([e.data, raw])
    return new


def append_all(t: ProtoType, e: Elements, n: np.ndarray, values: pa.Array, sizes: np.ndarray, packed: np.ndarray) -> Elements:
    """Append ``sizes[row]`` values to each row's field; ``packed`` per row joins them to a trailing LEN element."""
    packed = packed & t.packable & (sizes > 0)
    row = np.repeat(np.arange(e.rows), sizes)
    u, payload = _encode(t, values)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    next_i = e.next_i()
    plain = np.flatnonzero(~packed[row])
    joined = np.flatnonzero(packed[row])
    last = np.full(e.rows, -1)
    at = _field(e, n)
    last[e.row[at]] = at
    out = e
    if len(joined):
        raw, size = W.encode_values(t.wire, u[joined])
        per = np.bincount(row[joined], size, e.rows).astype(np.int64)
        start = np.cumsum(per) - per
        joins = packed & (last >= 0) & (e.t[last] == LEN if len(e.t) else False)
        onto, fresh = np.flatnonzero(joins), np.flatnonzero(packed & ~joins)
        if len(onto):  # old payload, then the new bytes
            el = last[onto]
            both = np.concatenate([e.data, raw])
            offs = np.stack([e.off[el], len(e.data) + start[onto]], 1).ravel()
            lens = np.stack([e.len[el], per[onto]], 1).ravel()
            whole = W.slices(both, offs, lens)
            size = e.len[el] + per[onto]
            out = _with_payload(out, el, whole, np.cumsum(size) - size, size)
        if len(fresh):
            out = out.plus(fresh, next_i[fresh], n[fresh], LEN, None, W.binary(raw, start[fresh], per[fresh]))
    if len(plain):
        r = row[plain]
        out = out.plus(r, next_i[r] + nth[plain], n[r], t.wire, None if u is None else u[plain], None if payload is None else payload.take(pa.array(plain)))
    return out


def append(t: ProtoType, e: Elements, n: np.ndarray, values: pa.Array, packed: np.ndarray) -> Elements:
    return append_all(t, e, n, values, np.ones(e.rows, np.int64), packed)


def extend(t: ProtoType, e: Elements, n: np.ndarray, lists: pa.Array, packed: np.ndarray) -> Elements:
    return append_all(t, e, n, *_flat(lists), packed)


def set_repeated(t: ProtoType, e: Elements, n: np.ndarray, lists: pa.Array, packed: np.ndarray) -> Elements:
    return extend(t, clear(e, n), n, lists, packed)


def _check(bad: np.ndarray, k: np.ndarray, top: np.ndarray) -> np.ndarray:
    _mark(bad, np.arange(len(k)), np.where((k < 0) | (k >= top), W.INDEX, W.OK))
    return bad == W.OK


def insert(t: ProtoType, e: Elements, bad: np.ndarray, n: np.ndarray, k: np.ndarray, values: pa.Array, packed: np.ndarray) -> Elements:
    """Insert at 0 <= k <= size. The whole field is written anew, in the encoding asked for, with fresh ordinals."""
    _, el, _, u, row, size = _logical(t, e, bad, n)
    ok = _check(bad, k, size + 1)
    rows = np.flatnonzero(ok)
    keep = ok[row]
    old_row = row[keep]
    new_u, payload = _encode(t, values.take(pa.array(rows)))
    total = np.where(ok, size + 1, 0)
    order = np.zeros(total.sum(), np.int64)
    order[(np.cumsum(total) - total)[rows] + k[rows]] = len(old_row) + 1 + np.arange(len(rows))
    order[order == 0] = 1 + np.arange(len(old_row))
    order -= 1
    row = np.r_[old_row, rows][order]
    nth = np.arange(len(row)) - np.repeat(np.cumsum(total) - total, total)
    next_i = e.next_i()
    gone = np.flatnonzero(~((e.n == n[e.row]) & ok[e.row]))
    rest = e.take(gone)
    if t.wire == LEN:
        raw, o = W.buffers(payload)
        off = np.r_[e.off[el[keep]], len(e.data) + o[:-1]][order]
        length = np.r_[e.len[el[keep]], np.diff(o)][order]
        return rest.plus(row, next_i[row] + nth, n[row], LEN, None, W.binary(np.concatenate([e.data, raw]), off, length))
    u = np.r_[u[keep], new_u][order]
    together = packed[row]
    out = rest
    if together.any():
        raw, size = W.encode_values(t.wire, u[together])
        per = np.bincount(row[together], size, e.rows).astype(np.int64)
        r = np.flatnonzero(packed & ok)
        out = out.plus(r, next_i[r], n[r], LEN, None, W.binary(raw, (np.cumsum(per) - per)[r], per[r]))
    alone = ~together
    return out.plus(row[alone], next_i[row[alone]] + nth[alone], n[row[alone]], t.wire, u[alone]) if alone.any() else out


def _rebuild(e: Elements, wire: int, el: np.ndarray, u: np.ndarray) -> Elements:
    """Packed elements with the payloads that their values ``u`` (in order, by element ``el``) make."""
    raw, size = W.encode_values(wire, u)
    start = np.flatnonzero(np.r_[True, el[1:] != el[:-1]][: len(el)])
    which = el[start]
    per = np.add.reduceat(size, start) if len(start) else np.zeros(0, np.int64)
    return _with_payload(e, which, raw, np.cumsum(per) - per, per)


def _among(e: Elements, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(e.row), bool)
    out[at] = True
    return out


def replace_(t: ProtoType, e: Elements, bad: np.ndarray, n: np.ndarray, k: np.ndarray, values: pa.Array) -> Elements:
    """Replace the k-th element where it is: its ordinal and encoding stay."""
    _, el, place, u, row, size = _logical(t, e, bad, n)
    ok = _check(bad, k, size)
    rows = np.flatnonzero(ok)
    at = (np.cumsum(size) - size)[rows] + k[rows]
    new_u, payload = _encode(t, values.take(pa.array(rows)))
    if t.wire == LEN:
        raw, o = W.buffers(payload)
        return _with_payload(e, el[at], raw, o[:-1], np.diff(o))
    single = place[at] < 0
    out = e.take(np.arange(len(e.row)))
    out.u[el[at[single]]] = new_u[single]
    if (~single).any():
        u = u.copy()
        u[at] = new_u
        touched = _among(e, el[at[~single]])[el]
        out = _rebuild(out, t.wire, el[touched], u[touched])
    return out


def remove(t: ProtoType, e: Elements, bad: np.ndarray, n: np.ndarray, k: np.ndarray) -> Elements:
    """Drop the k-th element; others keep their ordinals, an emptied packed element goes."""
    _, el, place, u, row, size = _logical(t, e, bad, n)
    ok = _check(bad, k, size)
    rows = np.flatnonzero(ok)
    at = (np.cumsum(size) - size)[rows] + k[rows]
    single = place[at] < 0
    gone = [el[at[single]]]
    out = e
    if (~single).any():
        hit = el[at[~single]]
        stays = _among(e, hit)[el]
        stays[at] = False
        gone.append(hit[~_among(e, el[stays])[hit]])
        out = _rebuild(out, t.wire, el[stays], u[stays])
    keep = np.ones(len(e.row), bool)
    keep[np.concatenate(gone)] = False
    return out.take(np.flatnonzero(keep))


def numbers(x, rows: int) -> np.ndarray:
    """A column of integers, or one integer for all rows, as an array."""
    if isinstance(x, (pa.Array, pa.ChunkedArray)):
        if x.null_count:
            raise WireError("a field number or an index is NULL")
        x = x.to_numpy(zero_copy_only=False) if isinstance(x, pa.Array) else x.to_numpy()
    return np.broadcast_to(np.asarray(x, np.int64), rows)
