"""ProtoJSON and number-JSON texts from messages and a schema."""

from __future__ import annotations

import base64
import json
import math
from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import ops as O
from . import wire as W
from .descriptors import Field, Schema, fields, scalar, unpacked
from .types import TYPES, WIDE, WireError, null_where

MAX_DEPTH = 255
OMIT = object()
# Messages that render as a plain value, by the type of their field 1.
WRAPPERS = {f".google.protobuf.{name}Value": kind for name, kind in (("Double", "double"), ("Float", "float"), ("Int64", "int64"), ("UInt64", "uint64"), ("Int32", "int32"), ("UInt32", "uint32"), ("Bool", "bool"), ("String", "string"), ("Bytes", "bytes"))}
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_FIRST, _LAST = (int((datetime(*x, tzinfo=timezone.utc) - _EPOCH).total_seconds()) for x in ((1, 1, 1), (9999, 12, 31, 23, 59, 59)))


def _last(data: bytes, kinds: dict[int, str]) -> dict[int, object]:
    """The last value of each known field whose wire type fits; others are passed over."""
    out = {}
    for n, t, v in fields(data):
        if n in kinds and t == TYPES[kinds[n]].wire:
            out.pop(n, None)
            out[n] = scalar(kinds[n], v)
    return out


def _fraction(nanos: int) -> str:
    if not nanos:
        return ""
    digits = f"{nanos:09d}"
    return "." + (digits[:3] if digits[3:] == "000000" else digits[:6] if digits[6:] == "000" else digits)


def _timestamp(data: bytes) -> str:
    f = _last(data, {1: "int64", 2: "int32"})
    try:
        when = _EPOCH + timedelta(seconds=f.get(1, 0))
    except OverflowError as e:
        raise WireError("Timestamp is out of range") from e
    return f"{when.year:04d}-{when:%m-%dT%H:%M:%S}{_fraction(f.get(2, 0))}Z"


def _duration(data: bytes) -> str:
    f = _last(data, {1: "int64", 2: "int32"})
    s, n = f.get(1, 0), f.get(2, 0)
    return f"{'-' if s < 0 or n < 0 else ''}{abs(s)}{_fraction(abs(n))}s"


def _value(data: bytes, depth: int):
    last = None
    for n, t, v in fields(data):
        if (n, t) in ((1, 0), (2, 1), (3, 2), (4, 0), (5, 2), (6, 2)):
            last = (n, v)
    if last is None or last[0] == 1:
        return None
    n, v = last
    if n == 2:
        return _number(scalar("double", v))
    if n in (3, 4):
        return scalar("string" if n == 3 else "bool", v)
    return _struct(v, depth + 1) if n == 5 else _list(v, depth + 1)


def _struct(data: bytes, depth: int) -> dict:
    _deep(depth)
    out = {}
    for n, t, v in fields(data):
        if (n, t) == (1, 2):
            entry = _last(v, {1: "string", 2: "message"})
            out[entry.get(1, "")] = _value(entry.get(2, b""), depth)
    return out


def _list(data: bytes, depth: int) -> list:
    _deep(depth)
    return [_value(v, depth) for n, t, v in fields(data) if (n, t) == (1, 2)]


def _number(x: float):
    if not math.isfinite(x):
        return None
    return int(x) if x == int(x) and abs(x) < 1e15 and not (x == 0 and math.copysign(1, x) < 0) else x


def _deep(depth: int) -> None:
    if depth > MAX_DEPTH:
        raise WireError("message nesting is too deep")


def _camel_path(path: str) -> str:
    head, *rest = path.split("_")
    return head + "".join(x[:1].upper() + x[1:] for x in rest)


class Renderer:
    """Renders messages of one schema. ``numbers`` picks number-JSON."""

    def __init__(self, schema: Schema, numbers: bool = False):
        self.schema, self.numbers = schema, numbers

    def plain(self, kind: str, v, type_name: str = ""):
        if kind == "enum":
            return v if self.numbers else self.schema.enums.get(type_name, {}).get(v, v)
        if kind == "bytes":
            return base64.b64encode(v).decode()
        if kind in ("float", "double"):
            return _number(v)
        return str(v) if not self.numbers and kind in ("int64", "uint64", "sint64", "fixed64", "sfixed64") else v

    def one(self, f: Field, v, depth: int):
        return self.message(f.type_name, v, depth + 1) if f.kind == "message" else self.plain(f.kind, v, f.type_name)

    def zero(self, f: Field):
        return self.plain(f.kind, TYPES[f.kind].zero, f.type_name)

    def message(self, name: str, data: bytes, depth: int = 0):
        _deep(depth)
        if name.startswith(".google.protobuf."):
            special = self.known(name, data, depth)
            if special is not OMIT:
                return special
        m = self.schema.message(name)
        found: dict[int, list] = {}
        order: dict[int, int] = {}
        for k, (n, t, v) in enumerate(fields(data)):
            f = m.by_number.get(n)
            if f is None:
                continue
            if f.kind == "group":
                raise WireError("groups are not supported")
            wire = TYPES[f.kind].wire
            if t != wire and not (f.repeated and t == 2):
                raise WireError("Unexpected wire type for the requested field")
            found.setdefault(n, []).extend(unpacked(f.kind, t, v) if f.repeated else [scalar(f.kind, v)])
            order[n] = k
        winners: dict[int, int] = {}
        for f in m.fields:
            if f.oneof is not None and f.number in order and order[f.number] >= order.get(winners.get(f.oneof), -1):
                winners[f.oneof] = f.number
        out, late = {}, {}
        for f in m.fields:
            key = str(f.number) if self.numbers else f.json_name
            values = found.get(f.number)
            entry = self.schema.messages.get(f.type_name) if f.kind == "message" and f.repeated else None
            if entry is not None and entry.map_entry:
                out[key] = self.map(entry, values or [], depth)
            elif f.repeated:
                out[key] = [self.one(f, v, depth) for v in values or []]
            elif values:
                x = self.one(f, values[-1], depth)
                missing = x is None and (f.kind in ("float", "double"))
                if f.oneof is not None:
                    if winners[f.oneof] == f.number and not missing:
                        late[key] = x
                elif not missing:
                    out[key] = x
            elif not f.presence:
                out[key] = self.zero(f)
        return out | late

    def map(self, entry, values: list[bytes], depth: int) -> dict:
        kf, vf = entry.by_number[1], entry.by_number[2]
        out = {}
        for data in values:
            k, v = TYPES[kf.kind].zero, None
            for n, t, x in fields(data):
                if n == 1 and t == TYPES[kf.kind].wire:
                    k = scalar(kf.kind, x)
                elif n == 2 and t == TYPES[vf.kind].wire:
                    v = scalar(vf.kind, x)
            key = ("true" if k else "false") if kf.kind == "bool" else str(k)
            v = TYPES[vf.kind].zero if v is None else v
            out[key] = self.one(vf, v, depth)
        return out

    def known(self, name: str, data: bytes, depth: int):
        if name in WRAPPERS:
            kind = WRAPPERS[name]
            return self.plain(kind, _last(data, {1: kind}).get(1, TYPES[kind].zero))
        short = name.removeprefix(".google.protobuf.")
        if short == "Timestamp":
            return _timestamp(data)
        if short == "Duration":
            return _duration(data)
        if short in ("Struct", "ListValue", "Value"):
            return {"Struct": _struct, "ListValue": _list, "Value": _value}[short](data, depth)
        if short == "Empty":
            return {}
        if short == "FieldMask":
            return ",".join(_camel_path(scalar("string", v)) for n, t, v in fields(data) if (n, t) == (1, 2))
        return OMIT

    def text(self, name: str, data: bytes | None) -> str | None:
        return None if data is None else json.dumps(self.message(name, bytes(data)), separators=(",", ":"), ensure_ascii=False)


#: Characters that a JSON string escapes.
_ESCAPED = r'["\\\x00-\x1f\x7f]'


def _quoted(text: pa.Array) -> pa.Array:
    """JSON strings; only texts that need escapes are looked at one by one."""
    odd = pc.fill_null(pc.match_substring_regex(text, _ESCAPED), False)
    out = pc.binary_join_element_wise('"', text, '"', "")
    if pc.any(odd).as_py():
        shown = [json.dumps(x, ensure_ascii=False) for x in text.filter(odd).to_pylist()]
        out = pc.replace_with_mask(out, odd, pa.array(shown, pa.string()))
    return out


class BatchRenderer:
    """Renders messages a batch at a time, a text column per field.

    For messages without oneofs, maps, groups, recursion and well-known types but Timestamp; ``suits`` says whether a type
    is one. All others go through ``Renderer``, whose texts are the same.
    """

    def __init__(self, schema: Schema, numbers: bool = False):
        self.schema, self.numbers, self.plain = schema, numbers, Renderer(schema, numbers).plain

    def suits(self, name: str, above: tuple[str, ...] = ()) -> bool:
        if name == ".google.protobuf.Timestamp":
            return True
        m = self.schema.messages.get(name)
        if m is None or name in above or m.map_entry or name.startswith(".google.protobuf."):
            return False
        return all(f.oneof is None and f.kind != "group" and (f.kind != "message" or self.suits(f.type_name, (*above, name))) for f in m.fields)

    def values(self, f: Field, x: pa.Array) -> pa.Array:
        """JSON texts of a field's values; a null stays null."""
        kind = f.kind
        if kind == "message":
            return self.message(f.type_name, x)
        if kind == "string":
            return _quoted(x)
        if kind in ("float", "double", "bytes", "enum"):
            d = pc.dictionary_encode(x)
            shown = [None if v is None else json.dumps(self.plain(kind, v, f.type_name), ensure_ascii=False) for v in d.dictionary.to_pylist()]
            shown = [None if v == "null" else v for v in shown]
            return pa.array(shown, pa.string()).take(d.indices)
        text = pc.cast(x, pa.string())
        return text if self.numbers or kind not in WIDE else pc.binary_join_element_wise('"', text, '"', "")

    def message(self, name: str, column: pa.Array) -> pa.Array:
        rows = len(column)
        e, bad = W.parse(column)
        if name == ".google.protobuf.Timestamp":
            seconds, nanos = (O.get(TYPES[k], e, bad, np.full(rows, n), pa.array([0] * rows)).to_numpy(zero_copy_only=False).astype(np.int64) for n, k in ((1, "int64"), (2, "int32")))
            W.fail(bad)
            if rows and (seconds.min() < _FIRST or seconds.max() > _LAST):
                raise WireError("Timestamp is out of range")
            days = pa.array(np.datetime_as_string(seconds.astype("datetime64[s]")), pa.string())
            some = np.unique(nanos, return_inverse=True)
            out = pc.binary_join_element_wise('"', days, pa.array([_fraction(int(n)) for n in some[0]], pa.string()).take(pa.array(some[1])), 'Z"', "")
            return null_where(out, np.asarray(column.is_null()))
        parts = []
        for f in self.schema.message(name).fields:
            t, n = TYPES[f.kind], np.full(rows, f.number)
            if f.repeated:
                lists = O.repeated(t, e, bad, n)
                shown = pc.fill_null(self.values(f, lists.flatten()), "null")
                text = pc.binary_join_element_wise("[", pc.binary_join(pa.ListArray.from_arrays(lists.offsets, shown), ","), "]", "")
            else:
                there = O.get(t, e, bad, n, None)
                text = self.values(f, there)
                if not f.presence:
                    # an absent field shows its zero, a value that JSON cannot say is left out
                    zero = json.dumps(self.plain(f.kind, t.zero, f.type_name), ensure_ascii=False)
                    text = pc.if_else(O.has(t, e, bad, n), text, zero)
            W.fail(bad)
            key = json.dumps(str(f.number) if self.numbers else f.json_name, ensure_ascii=False)
            parts.append(pc.binary_join_element_wise(f"{key}:", text, ""))
        body = pc.binary_join_element_wise(*parts, ",", null_handling="skip") if parts else pa.array([""] * rows, pa.string())
        return null_where(pc.binary_join_element_wise("{", body, "}", ""), np.asarray(column.is_null()))


def _render(schema: Schema, name: str, source, numbers: bool, on_error: str) -> Column:
    schema.message(name) if not name.startswith(".google.protobuf.") else None
    text = schema.to_json()
    held: list = []

    def run(column: pa.Array) -> pa.Array:
        if not held:
            read = Schema.from_json(text)
            held.extend((Renderer(read, numbers), BatchRenderer(read, numbers), BatchRenderer(read, numbers).suits(name)))
        if held[2]:
            try:
                return held[1].message(name, column)
            except WireError:  # the rows one by one say which are wrong
                pass
        out = []
        for x in column.to_pylist():
            try:
                out.append(held[0].text(name, x))
            except WireError:
                if on_error == "raise":
                    raise
                out.append(None)
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(F.col(source) if isinstance(source, str) else source)


def to_json(schema: Schema, name: str, source, on_error: str = "raise") -> Column:
    """ProtoJSON text; null stays null. An unknown type is an error when the plan is built."""
    return _render(schema, name, source, False, on_error)


def to_number_json(schema: Schema, name: str, source, on_error: str = "raise") -> Column:
    """The same with field numbers as keys, enum numbers and unquoted 64-bit integers."""
    return _render(schema, name, source, True, on_error)


def message_to_json_batch(schemas: pa.Array, names: pa.Array, messages: pa.Array) -> pa.Array:
    """The SQL form: the schema text is an argument, nearly always the same for all rows."""
    if len(schemas) and schemas[0].is_valid and names[0].is_valid and pc.all(pc.equal(schemas, schemas[0])).as_py() and pc.all(pc.equal(names, names[0])).as_py():
        whole = BatchRenderer(Schema.from_json(schemas[0].as_py()))
        if whole.suits(names[0].as_py()) and not schemas.null_count and not names.null_count:
            try:
                return whole.message(names[0].as_py(), messages)
            except WireError:
                pass
    held: dict[str, Renderer] = {}
    out = []
    for text, name, data in zip(schemas.to_pylist(), names.to_pylist(), messages.to_pylist(), strict=True):
        if data is None or text is None:
            out.append(None)
            continue
        if text not in held:
            held.clear()
            held[text] = Renderer(Schema.from_json(text))
        out.append(held[text].text(name, data))
    return pa.array(out, pa.string())


def build_descriptor_set_batch(blobs: pa.Array) -> pa.Array:
    return pa.array([None if b is None else Schema.from_descriptor_set(b).to_json() for b in blobs.to_pylist()], pa.string())
