"""Wire JSON: ``{"field number": [{"i": ordinal, "n": number, "t": wire type, "v": value}, ...]}``.

``v`` is an unsigned integer, or base64 for wire type 2. Keys run by number. The text form exists
only at the edge: inside, both representations are the same element arrays.

Texts as ``render`` writes them are read a batch at a time, with a cursor per element; any other
text (white space, other orders, escapes, wrapped base64) goes through ``json``, row by row.
"""

from __future__ import annotations

import base64
import json

import numpy as np
import pyarrow as pa

from . import wire as W
from .types import LEN, WireError

_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_SIX = np.full(256, 255, np.uint8)
_SIX[_ALPHABET] = np.arange(64)
_TENS = np.array([10**k for k in range(20)], np.uint64)
#: The column that was read last and the one that was rendered last, with their elements.
_last: list = [None, None]
_rendered: list = [None, None]
#: What stands before an element's ordinal, field number, wire type and value.
_I, _N, _T, _V = (np.frombuffer(x, np.uint8) for x in (b'{"i":', b',"n":', b',"t":', b',"v":'))


def base64_texts(data: np.ndarray, off: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(base64 of slices one after another, size of each)."""
    groups = -(-length // 3)
    ends = np.cumsum(groups)
    padded = np.zeros(3 * int(ends[-1]) if len(ends) else 0, np.uint8)
    padded[W.spread(3 * (ends - groups), length)] = data[W.spread(off, length)]
    a, b, c = padded.reshape(-1, 3).T
    out = _ALPHABET[np.stack([a >> 2, (a & 3) << 4 | b >> 4, (b & 15) << 2 | c >> 6, c & 63], 1)].ravel()
    for k in (1, 2):
        out[4 * ends[length % 3 == 3 - k][:, None] - np.arange(1, k + 1)] = ord("=")
    return out, 4 * groups


def _from_base64(data: np.ndarray, off: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offset and length of each payload, whether its text is plain base64)."""
    ok = length % 4 == 0
    length = np.where(ok, length, 0)
    last = off + length - 1
    pads = np.where(length > 0, (data[last] == ord("=")).astype(np.int64) + ((data[last] == ord("=")) & (data[last - 1] == ord("="))), 0) if len(off) else length
    six = _SIX[data[W.spread(off, length)]]
    ends = np.cumsum(length)
    for k in (1, 2):
        six[(ends[pads >= k] - k)] = 0
    wrong = np.flatnonzero(six == 255)
    ok[np.searchsorted(ends, wrong, "right")] = False
    a, b, c, d = six.reshape(-1, 4).T
    out = np.stack([a << 2 | b >> 4, (b & 15) << 4 | c >> 2, (c & 3) << 6 | d], 1).ravel()
    return out, (ends - length) // 4 * 3, length // 4 * 3 - pads, ok


def _digits(u: np.ndarray) -> np.ndarray:
    size = np.ones(len(u), np.int64)
    top = u.max() if len(u) else 0
    for ten in _TENS[1:]:
        if ten > top:
            break
        size += u >= ten
    return size


def _put_numbers(out: np.ndarray, end: np.ndarray, u: np.ndarray) -> None:
    """Decimal digits that end before ``end``."""
    at, rest = end - 1, u
    while len(at):
        more = rest // np.uint64(10)
        out[at] = (rest - more * np.uint64(10)).astype(np.uint8) + 48
        live = more > 0
        at, rest = at[live] - 1, more[live]


def _put(out: np.ndarray, at: np.ndarray, text: np.ndarray) -> None:
    for k, x in enumerate(text):
        out[at + k] = x


def render(e: W.Elements, valid: np.ndarray | None = None) -> pa.Array:
    """A pass for sizes, then a pass that scatters."""
    e = e.take(np.lexsort((e.i, e.n, e.row)))
    i, n, m = e.i.astype(np.uint64), e.n.astype(np.uint64), len(e.row)
    new_row = np.r_[True, e.row[1:] != e.row[:-1]][:m]
    new = new_row | np.r_[True, e.n[1:] != e.n[:-1]][:m]
    payload = e.t == LEN
    coded, coded_size = base64_texts(e.data, e.off[payload], e.len[payload])
    size_n, size_v = _digits(n), _digits(e.u)
    size_v[payload] = coded_size + 2
    # what stands before an element: {"n":[ or ],"n":[ or a comma
    lead = np.where(new, size_n + 5 + ~new_row, 1)
    end_i = lead + 5 + _digits(i)
    end_n = end_i + 5 + size_n
    size = end_n + 11 + size_v + 1
    last = np.flatnonzero(np.r_[new_row[1:], True][:m])
    size[last] += 2
    per_row = np.zeros(e.rows, np.int64)
    np.add.at(per_row, e.row, size)
    nothing = per_row == 0
    per_row[nothing] = 2
    row_ends = np.cumsum(per_row)
    if e.rows and row_ends[-1] >= 1 << 31:
        raise WireError("a batch holds over 2 GB of texts; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    out = np.zeros(row_ends[-1] if e.rows else 0, np.uint8)
    # elements follow one another, but for the texts of rows without any
    before = np.cumsum(np.where(nothing, 2, 0))
    start = np.cumsum(size) - size + before[e.row] if m else np.zeros(0, np.int64)
    out[row_ends[nothing] - 2], out[row_ends[nothing] - 1] = ord("{"), ord("}")
    out[start[~new]] = ord(",")
    _put(out, start[new_row], b"{")
    _put(out, start[new & ~new_row], b"],")
    head = np.flatnonzero(new)
    begin = (start + lead)[head]
    _put(out, begin - 3, b'":[')
    _put_numbers(out, begin - 3, n[head])
    out[begin - 4 - size_n[head]] = ord('"')
    for at, text in ((start + lead, _I), (start + end_i, _N), (start + end_n, _T), (start + end_n + 6, _V)):
        _put(out, at, text)
    _put_numbers(out, start + end_i, i)
    _put_numbers(out, start + end_n, n)
    out[start + end_n + 5] = e.t.astype(np.uint8) + 48
    value = start + end_n + 11
    _put_numbers(out, (value + size_v)[~payload], e.u[~payload])
    out[value[payload]] = out[(value + size_v)[payload] - 1] = ord('"')
    out[W.spread(value[payload] + 1, coded_size)] = coded
    out[value + size_v] = ord("}")
    _put(out, row_ends[e.row[last]] - 2, b"]}")
    mask = None if valid is None or valid.all() else pa.array(valid).buffers()[1]
    texts = pa.Array.from_buffers(pa.string(), e.rows, [mask, pa.py_buffer(np.r_[0, row_ends].astype(np.int32)), pa.py_buffer(out)])
    _rendered[:] = texts, e if mask is None else e.take(np.flatnonzero(valid[e.row]))
    return texts


def _numbers(data: np.ndarray, pos: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, position after it, whether it is a plain number of at most ``most`` digits below 2^64) of the number at each position."""
    value, after = np.zeros(len(pos), np.uint64), pos.copy()
    ok = np.ones(len(pos), bool)
    live = np.arange(len(pos))
    for k in range(most + 1):
        d = data[after[live]] - np.uint8(48)
        more = d < 10
        live, d = live[more], d[more].astype(np.uint64)
        if not len(live):
            break
        if k == most:
            ok[live] = False
            break
        was = value[live]
        if k == 19:
            ok[live[(was > np.uint64(1844674407370955161)) | ((was == np.uint64(1844674407370955161)) & (d > 5))]] = False
        value[live] = was * np.uint64(10) + d
        after[live] += 1
    size = after - pos
    return value, after, ok & (size > 0) & ((size == 1) | (data[pos] != 48))


def _is(data: np.ndarray, pos: np.ndarray, text: bytes | np.ndarray) -> np.ndarray:
    out = np.ones(len(pos), bool)
    for k, x in enumerate(text):
        out &= data[pos + k] == x
    return out


def _read_plain(data: np.ndarray, off: np.ndarray) -> tuple[W.Elements, np.ndarray]:
    """Elements of the rows whose texts are byte for byte as ``render`` may write them, and which rows are not."""
    rows, begin, end = len(off) - 1, off[:-1], off[1:]
    odd = np.zeros(rows, bool)
    size = end - begin
    data = np.r_[data[off[0] : off[-1]], np.zeros(32, np.uint8)]  # cursors may run over the end
    begin, end = begin - off[0], end - off[0]
    odd[size == 1] = True
    full = np.flatnonzero(size >= 2)
    odd[full[~(_is(data, begin[full], b"{") & _is(data, end[full] - 1, b"}"))]] = True
    at = np.flatnonzero(data == ord("{"))
    row = np.searchsorted(end, at, "right")
    inner = at != begin[row]
    at, row = at[inner], row[inner]
    held = np.bincount(row, minlength=rows)
    odd[(held == 0) & (size != 2) & (size != 0)] = True
    i, p, ok = _numbers(data, at + 5, 18)
    ok &= _is(data, at, _I) & _is(data, p, _N)
    n, p, good = _numbers(data, np.where(ok, p + 5, 0), 18)
    ok &= good & _is(data, p, _T)
    p = np.where(ok, p + 5, 0)
    t = (data[p] - np.uint8(48)).astype(np.int8)
    ok &= ((t == W.VARINT) | (t == W.I64) | (t == LEN) | (t == W.I32)) & _is(data, p + 1, _V)
    p = np.where(ok, p + 6, 0)
    u, after, good = _numbers(data, p, 20)
    payload = np.flatnonzero(ok & (t == LEN))
    ok &= good | (t == LEN)
    quotes = np.flatnonzero(data == ord('"'))
    closing = quotes[np.minimum(np.searchsorted(quotes, p[payload], "right"), len(quotes) - 1)] if len(quotes) else p[payload]
    ok[payload] &= (data[p[payload]] == ord('"')) & (closing > p[payload]) & (closing < end[row[payload]])
    payload, closing = payload[ok[payload]], closing[ok[payload]]
    raw, where, length, good = _from_base64(data, p[payload] + 1, closing - p[payload] - 1)
    ok[payload] &= good
    after[payload] = closing + 1
    u[t == LEN] = 0
    ok &= data[after] == ord("}")
    after = after + 1  # past the element
    # what stands between: a comma, or the end of a list and the next one's number, or the row's begin
    first = np.r_[True, row[1:] != row[:-1]][: len(row)]
    since = np.where(first, begin[row] + 1, np.r_[0, after[:-1]][: len(row)])
    follows = ~first & (at == since + 1) & (data[since] == ord(","))
    opens = ~follows & (first | _is(data, since, b"],"))
    since = np.where(first, since, since + 2)
    key, p, good = _numbers(data, np.where(opens, since + 1, 0), 18)
    opens &= good & (data[since] == ord('"')) & _is(data, p, b'":[') & (at == p + 3) & (key == n)
    ok &= opens | follows
    before = np.r_[0, n[:-1]][: len(row)]
    ok &= np.where(first, True, np.where(follows, n == before, n > before))
    last = np.flatnonzero(np.r_[row[1:] != row[:-1], True][: len(row)])
    ok[last] &= _is(data, after[last], b"]}") & (after[last] + 2 == end[row[last]])
    odd[row[~ok]] = True
    off_, len_ = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
    off_[payload], len_[payload] = where, length
    e = W.Elements(rows, row, i.astype(np.int64), n.astype(np.int64), t, u, off_, len_, raw)
    return (e.take(np.flatnonzero(~odd[row])) if odd.any() else e), odd


def elements(text: str | None):
    """(ordinal, field number, wire type, bits, payload, value as it stands) of each element of one text, as ``json`` reads it."""
    for number, found in (json.loads(text) if text else {}).items():
        for x in found:
            kind, v = x["t"], x["v"]
            if kind not in (W.VARINT, W.I64, W.LEN, W.I32):
                raise WireError(f"Unsupported wire type {kind}")
            u, payload = (0, base64.b64decode(v)) if kind == LEN else (int(v), b"")
            if not 0 <= u < 1 << 64:
                raise WireError("Value out of range")
            yield x["i"], int(x.get("n", number)), kind, u, payload, v


def _read_any(texts: list[str], at: np.ndarray, rows: int) -> W.Elements:
    found = [(k, *x[:5]) for k, text in zip(at.tolist(), texts, strict=True) for x in elements(text)]
    row, i, n, t, u, payload = zip(*found, strict=True) if found else ((),) * 6
    data, off = W.buffers(pa.array(payload, pa.binary()))
    a = lambda x, k: np.array(x, k)
    return W.Elements(rows, a(row, np.int64), a(i, np.int64), a(n, np.int64), a(t, np.int8), a(u, np.uint64), off[:-1].copy(), np.diff(off), data)




def read(column: pa.Array) -> W.Elements:
    """Elements of wire JSON texts; a null is empty. Wrapped base64 is accepted.

    Functions of one column get the same array, and a chained function gets the very array that was rendered for it;
    edits never change elements in place, so what was read or rendered last is not read again.
    """
    if _rendered[0] is column:
        e = _rendered[1]
        return e.take(np.lexsort((e.i, e.row)))
    if _last[0] is not column:
        _last[:] = column, _read(column)
    return _last[1]


def _read(column: pa.Array) -> W.Elements:
    e, odd = _read_plain(*W.buffers(column))
    if odd.any():
        at = np.flatnonzero(odd)
        more = _read_any(column.take(pa.array(at)).to_pylist(), at, len(column))
        both = {k: np.concatenate([getattr(e, k), getattr(more, k)]) for k in ("row", "i", "n", "t", "u", "len", "data")}
        e = W.Elements(len(column), off=np.concatenate([e.off, more.off + len(e.data)]), **both)
    return e.take(np.lexsort((e.i, e.row)))
