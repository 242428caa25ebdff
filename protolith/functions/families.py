"""The public families: names, argument lists and Arrow implementations, for both representations."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import ops as O
from . import wire as W
from . import wirejson as J
from .types import LEN, TYPES, U64, WIDE, ProtoType, WireError, null_where

MESSAGE, WIRE_JSON = "message", "wire_json"


@dataclass(frozen=True)
class Family:
    """``name`` with ``{k}`` and ``{T}``; ``args`` after the message; what is returned."""

    key: str
    name: str
    args: tuple[str, ...]
    edits: bool = False


FAMILIES = {
    f.key: f
    for f in (
        Family("get", "pb_{k}_get_{T}_field", ("n", "default")),
        Family("has", "pb_{k}_has_{T}_field", ("n",)),
        Family("element", "pb_{k}_get_repeated_{T}_field_element", ("n", "k")),
        Family("count", "pb_{k}_get_repeated_{T}_field_count", ("n",)),
        Family("set", "pb_{k}_set_{T}_field", ("n", "value"), True),
        Family("add", "pb_{k}_add_repeated_{T}_field_element", ("n", "value", "packed"), True),
        Family("add_all", "pb_{k}_add_all_repeated_{T}_field_elements", ("n", "values", "packed"), True),
        Family("insert", "pb_{k}_insert_repeated_{T}_field_element", ("n", "k", "value", "packed"), True),
        Family("replace", "pb_{k}_set_repeated_{T}_field_element", ("n", "k", "value"), True),
        Family("remove", "pb_{k}_remove_repeated_{T}_field_element", ("n", "k"), True),
        Family("clear", "pb_{k}_clear_{T}_field", ("n",), True),
        Family("clear_repeated", "pb_{k}_clear_repeated_{T}_field", ("n",), True),
        Family("set_repeated", "pb_{k}_set_repeated_{T}_field", ("n", "values", "packed"), True),
        Family("json_array", "pb_{k}_get_repeated_{T}_field_as_json_array", ("n",)),
        Family("json_string_array", "pb_{k}_get_repeated_{T}_field_as_json_string_array", ("n",)),
    )
}


def _plain(t: ProtoType, v):
    """The JSON value of an element."""
    if isinstance(v, bytes):
        return base64.b64encode(v).decode()
    return int(v) if isinstance(v, Decimal) else v


def _plain_texts(t: ProtoType, values: pa.Array, quoted: bool) -> pa.Array | None:
    """JSON of each element, or None if that takes more than a cast, quotes or base64."""
    mark = ""
    if t.name == "string":
        raw, off = W.buffers(values)
        raw = raw[off[0] : off[-1]]
        if ((raw < 32) | (raw == ord('"')) | (raw == ord("\\"))).any():
            return None
        texts, mark = values, '"'
    elif t.wire == LEN:
        raw, off = W.buffers(values)
        coded, size = J.base64_texts(raw, off[:-1], np.diff(off))
        ends = np.cumsum(size)
        texts, mark = null_where(W.binary(coded, ends - size, size).cast(pa.string()), np.asarray(values.is_null())), '"'
    elif t.name in ("float", "double") or quoted and t.name == "bool":
        return None
    else:
        texts, mark = _integers(values).cast(pa.string()), '"' if quoted else ""
    texts = pc.binary_join_element_wise(mark, texts, mark, "") if mark else texts
    return texts.fill_null("null")


def _integers(values: pa.Array) -> pa.Array:
    """Decimals of 64 bits as what they are, which show much sooner."""
    if values.type != U64:
        return values
    u = np.frombuffer(values.buffers()[1], np.uint64)[2 * values.offset : 2 * (values.offset + len(values)) : 2] if len(values) else np.zeros(0, np.uint64)
    return null_where(pa.array(u), np.asarray(values.is_null()))


def json_texts(t: ProtoType, lists: pa.Array, quoted: bool) -> pa.Array:
    values, sizes = O._flat(lists)
    texts = _plain_texts(t, values, quoted)
    if texts is not None:
        ends = np.cumsum(sizes)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), texts), ",")
        return null_where(pc.binary_join_element_wise("[", joined, "]", ""), np.asarray(lists.is_null()))
    show = (lambda v: str(int(v))) if quoted else (lambda v: _plain(t, v))
    return pa.array([None if x is None else json.dumps([None if v is None else show(v) for v in x], separators=(",", ":"), ensure_ascii=False) for x in lists.to_pylist()], pa.string())


def from_json_texts(t: ProtoType, texts: pa.Array) -> pa.Array:
    """Lists from JSON arrays. 64-bit integers may be strings, bytes and messages are base64."""

    def one(v):
        if v is None:
            return None
        if t.wire == LEN:
            return v if t.name == "string" else base64.b64decode(v)
        if t.name == "bool":
            return bool(v)
        if t.arrow == U64:
            return Decimal(int(v))
        return float(v) if t.name in ("float", "double") else int(v)

    kind = pa.int64() if pa.types.is_integer(t.arrow) else t.arrow
    return pa.array([None if x is None else [one(v) for v in json.loads(x)] for x in texts.to_pylist()], pa.list_(kind))


def returns(kind: str, family: str, t: ProtoType, as_list: bool = False) -> str:
    if FAMILIES[family].edits:
        return "binary" if kind == MESSAGE else "string"
    if as_list:
        return f"array<{t.spark}>"
    return {"get": t.spark, "element": t.spark, "has": "boolean", "count": "int"}.get(family, "string")


def implement(kind: str, family: str, t: ProtoType, on_error: str = "raise", as_list: bool = False) -> Callable[..., pa.Array]:
    """An Arrow function of (message, arguments...); numbers, indices and ``packed`` may be one Python value for all rows. ``on_error='null'`` gives null for rows in error instead of raising."""
    spec = FAMILIES[family]
    names = [a for a in spec.args if a != "packed" or t.packable]

    def run(*columns: pa.Array) -> pa.Array:
        source = columns[0].combine_chunks() if isinstance(columns[0], pa.ChunkedArray) else columns[0]
        a = dict(zip(names, columns[1:], strict=True))
        rows = len(source)
        n = O.numbers(a["n"], rows)
        if kind == MESSAGE:
            e, bad = W.parse(source, None if spec.edits else n)
        else:
            e, bad = J.read(source), np.zeros(rows, np.int8)
        k = O.numbers(a["k"], rows) if "k" in a else None
        packed = np.zeros(rows, bool)
        if "packed" in a:
            asked = a["packed"]
            packed = np.full(rows, asked) if isinstance(asked, bool) else np.asarray(asked.cast(pa.bool_()).fill_null(False).to_numpy(zero_copy_only=False), bool)
        lists = a.get("values")
        if lists is not None and (pa.types.is_string(lists.type) or pa.types.is_large_string(lists.type)):
            lists = from_json_texts(t, lists)
        text = O.BOUNDS if spec.edits else None
        if not spec.edits:
            if family == "get":
                out = O.get(t, e, bad, n, a["default"])
            elif family == "has":
                out = O.has(t, e, bad, n)
            elif family == "count":
                out = O.count(t, e, bad, n)
            elif family == "element":
                out = O.element(t, e, bad, n, k)
            else:
                out = O.repeated(t, e, bad, n)
            if on_error == "raise":
                W.fail(bad, text)
            out = null_where(out, bad != W.OK)
            if not as_list and family.startswith("json"):
                out = json_texts(t, out, family == "json_string_array")
            return out
        if on_error == "raise":
            W.fail(bad, text)
        if family == "set":
            e = O.set_(t, e, n, a["value"])
        elif family == "add":
            e = O.append(t, e, n, a["value"], packed)
        elif family == "add_all":
            e = O.extend(t, e, n, lists, packed)
        elif family == "set_repeated":
            e = O.set_repeated(t, e, n, lists, packed)
        elif family == "insert":
            e = O.insert(t, e, bad, n, k, a["value"], packed)
        elif family == "replace":
            e = O.replace_(t, e, bad, n, k, a["value"])
        elif family == "remove":
            e = O.remove(t, e, bad, n, k)
        else:
            e = O.clear(e, n)
        if on_error == "raise":
            W.fail(bad, text)
        good = bad == W.OK
        if kind == MESSAGE:
            return W.serialise(e, good)
        return J.render(e, good & ~np.asarray(source.is_null()))

    return run


def public_names() -> Iterator[tuple[str, str, str, ProtoType]]:
    """(SQL name, representation, family, type) of every generated public function."""
    for kind in (MESSAGE, WIRE_JSON):
        for key, f in FAMILIES.items():
            for t in TYPES.values():
                if key != "json_string_array" or t.name in WIDE:
                    yield f.name.format(k=kind, T=t.name), kind, key, t


def to_wire_json(column: pa.Array) -> pa.Array:
    e, bad = W.parse(column)
    W.fail(bad)
    return J.render(e)


def from_wire_json(column: pa.Array) -> pa.Array:
    return W.serialise(J.read(column), ~np.asarray(column.is_null()))


__all__ = ["FAMILIES", "MESSAGE", "WIRE_JSON", "WireError", "from_wire_json", "implement", "public_names", "returns", "to_wire_json"]
