"""Column functions over message columns.

``from protolith.functions import pb``; then ``pb.get("msg", 2, "int32", 0)`` and so on. Field
numbers, indices and values are Python literals or columns. Each function exists once for
messages (binary) and, with ``kind="wire_json"``, for wire JSON texts.

Plain integers and flags go into the function itself instead of a column of their own. A call with no other
arguments has a single child, so Spark chains it to the call that it reads in one Python worker, and what
passes between them never leaves it.

``once=True`` counts as nondeterministic, so that Catalyst evaluates a column once, however many expressions
read it, and doesn't copy it into each; filter plain columns before.

``on_error="null"`` gives null where the default raises: Python functions inside ``CASE`` run for
all rows, so a guard cannot keep them from an error.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import ops as O
from . import wire as W
from . import wirejson as J
from .families import MESSAGE, WIRE_JSON, from_wire_json, implement, returns, to_wire_json
from .types import LEN, TYPES, ProtoType, null_where


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _udf(f, kind: str):
    return F.arrow_udf(_scalar(f), kind)


def _scalar(f):
    def run(*columns: pa.Array) -> pa.Array:
        return f(*columns)

    return run


def _value(t: ProtoType, x) -> Column:
    if isinstance(x, Column):
        return x
    return F.lit(bytes(x) if isinstance(x, (bytes, bytearray)) else x).cast(t.spark)


def _bound(f, args: Sequence):
    """``f`` with those of its arguments in it that are no columns."""

    def run(source: pa.Array, *columns: pa.Array) -> pa.Array:
        rest = iter(columns)
        return f(source, *(next(rest) if x is None else x for x in fixed))

    fixed = [None if isinstance(x, Column) else x for x in args]
    return run


def _call(family: str, source, type_name: str, *args, kind: str = MESSAGE, on_error: str = "raise", as_list: bool = False, once: bool = False) -> Column:
    t = TYPES[type_name]
    args = [x if type(x) in (int, bool) else _lit(x) for x in args]
    f = _udf(_bound(implement(kind, family, t, on_error, as_list), args), returns(kind, family, t, as_list))
    return (f.asNondeterministic() if once else f)(_col(source), *(x for x in args if isinstance(x, Column)))


def _packed(type_name: str, packed: bool) -> tuple:
    return (packed,) if TYPES[type_name].packable else ()


def get(source, n: int, type_name: str, default=None, **o) -> Column:
    """The last occurrence of a field, or ``default``."""
    return _call("get", source, type_name, n, _value(TYPES[type_name], default), **o)


def has(source, n: int, type_name: str, **o) -> Column:
    return _call("has", source, type_name, n, **o)


def count(source, n: int, type_name: str, **o) -> Column:
    return _call("count", source, type_name, n, **o)


def element(source, n: int, type_name: str, k, **o) -> Column:
    return _call("element", source, type_name, n, k, **o)


def get_repeated(source, n: int, type_name: str, **o) -> Column:
    """All elements as an array."""
    return _call("json_array", source, type_name, n, as_list=True, **o)


def as_json_array(source, n: int, type_name: str, **o) -> Column:
    return _call("json_array", source, type_name, n, **o)


def as_json_string_array(source, n: int, type_name: str, **o) -> Column:
    return _call("json_string_array", source, type_name, n, **o)


def set(source, n: int, type_name: str, value, **o) -> Column:  # noqa: A001
    return _call("set", source, type_name, n, _value(TYPES[type_name], value), **o)


def add(source, n: int, type_name: str, value, packed: bool = False, **o) -> Column:
    return _call("add", source, type_name, n, _value(TYPES[type_name], value), *_packed(type_name, packed), **o)


def add_all(source, n: int, type_name: str, values, packed: bool = False, **o) -> Column:
    return _call("add_all", source, type_name, n, values, *_packed(type_name, packed), **o)


def insert(source, n: int, type_name: str, k, value, packed: bool = False, **o) -> Column:
    return _call("insert", source, type_name, n, k, _value(TYPES[type_name], value), *_packed(type_name, packed), **o)


def replace(source, n: int, type_name: str, k, value, **o) -> Column:
    return _call("replace", source, type_name, n, k, _value(TYPES[type_name], value), **o)


def remove(source, n: int, type_name: str, k, **o) -> Column:
    return _call("remove", source, type_name, n, k, **o)


def clear(source, n: int, type_name: str = "int32", **o) -> Column:
    return _call("clear", source, type_name, n, **o)


def clear_repeated(source, n: int, type_name: str = "int32", **o) -> Column:
    return _call("clear_repeated", source, type_name, n, **o)


def set_repeated(source, n: int, type_name: str, values, packed: bool = False, **o) -> Column:
    return _call("set_repeated", source, type_name, n, values, *_packed(type_name, packed), **o)


def new() -> Column:
    return F.lit(b"")


def wire_json_new() -> Column:
    return F.lit("{}")


def wire_json(source, once: bool = False) -> Column:
    """A message as wire JSON; null gives ``{}``."""
    f = _udf(to_wire_json, "string")
    return (f.asNondeterministic() if once else f)(_col(source))


def from_wire(source) -> Column:
    """A message from wire JSON, elements by ordinal."""
    return _udf(from_wire_json, "binary")(_col(source))


ELEMENTS = "array<struct<i:int,n:int,t:tinyint,u:bigint,b:binary>>"


def elements(source) -> Column:
    """The wire elements of a message in wire order; ``u`` has the 64 raw bits, ``b`` the payload of LEN elements. ``F.inline`` makes the wire table of it."""

    def run(column: pa.Array) -> pa.Array:
        e, bad = W.parse(column)
        W.fail(bad)
        b = null_where(W.binary(e.data, e.off, e.len), e.t != LEN)
        u = null_where(pa.array(e.u.view(np.int64)), e.t == LEN)
        items = pa.StructArray.from_arrays([pa.array(e.i.astype(np.int32)), pa.array(e.n.astype(np.int32)), pa.array(e.t), u, b], ["i", "n", "t", "u", "b"])
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(e.row, minlength=e.rows))].astype(np.int32)), items)

    return _udf(run, ELEMENTS)(_col(source))


def extract(source, fields: dict[str, tuple], on_error: str = "raise") -> Column:
    """Several fields in one pass, as a struct.

    ``fields`` maps a name to ``(n, type)``, ``(n, type, default)`` or ``(n, type, "repeated")``.
    The expression counts as nondeterministic, so that Catalyst evaluates it once even if a filter and
    a projection use it; filter plain columns before.
    """
    plan = []
    for name, (n, type_name, *rest) in fields.items():
        many = rest == ["repeated"] and type_name != "string" or rest == ["repeated"]
        plan.append((name, n, TYPES[type_name], many, rest[0] if rest and not many else None))
    schema = "struct<" + ",".join(f"`{name}`:" + (f"array<{t.spark}>" if many else t.spark) for name, _, t, many, _ in plan) + ">"

    def run(column: pa.Array) -> pa.Array:
        e, bad = W.parse(column)
        out = []
        for _, n, t, many, default in plan:
            numbers, fallback = np.full(len(column), n), None if default is None else pa.array([default] * len(column), pa.int64() if isinstance(default, int) and not isinstance(default, bool) else None)
            out.append(O.repeated(t, e, bad, numbers) if many else O.get(t, e, bad, numbers, fallback))
        if on_error == "raise":
            W.fail(bad)
        return pa.StructArray.from_arrays([null_where(x, bad != W.OK) for x in out], [name for name, *_ in plan])

    return F.arrow_udf(_scalar(run), schema).asNondeterministic()(_col(source))


class Edit:
    """An edit program on a message: steps gather on the driver and run as one function call with one parse and one write."""

    def __init__(self, source):
        self.source, self.steps, self.columns = _col(source), [], []

    def _step(self, family: str, n: int, t: ProtoType | None, packed: bool = False, **args) -> Edit:
        places = {}
        for name, x in args.items():
            places[name] = len(self.columns)
            self.columns.append(_value(t, x) if name == "value" else _lit(x))
        new = Edit(self.source)
        new.columns, new.steps = list(self.columns), [*self.steps, (family, n, t, packed, places)]
        return new

    def set(self, n, type_name, value):
        return self._step("set", n, TYPES[type_name], value=value)

    def add(self, n, type_name, value, packed=False):
        return self._step("add", n, TYPES[type_name], packed, value=value)

    def add_all(self, n, type_name, values, packed=False):
        return self._step("add_all", n, TYPES[type_name], packed, values=values)

    def set_repeated(self, n, type_name, values, packed=False):
        return self._step("set_repeated", n, TYPES[type_name], packed, values=values)

    def insert(self, n, type_name, k, value, packed=False):
        return self._step("insert", n, TYPES[type_name], packed, k=k, value=value)

    def replace(self, n, type_name, k, value):
        return self._step("replace", n, TYPES[type_name], k=k, value=value)

    def remove(self, n, type_name, k):
        return self._step("remove", n, TYPES[type_name], k=k)

    def clear(self, n):
        return self._step("clear", n, None)

    def to_message(self) -> Column:
        steps = self.steps

        def run(column: pa.Array, *args: pa.Array) -> pa.Array:
            e, bad = W.parse(column)
            W.fail(bad)
            rows = len(column)
            for family, number, t, packed, places in steps:
                n, p = np.full(rows, number), np.full(rows, packed)
                a = {name: args[at] for name, at in places.items()}
                k = O.numbers(a["k"], rows) if "k" in a else None
                if family == "set":
                    e = O.set_(t, e, n, a["value"])
                elif family == "add":
                    e = O.append(t, e, n, a["value"], p)
                elif family == "add_all":
                    e = O.extend(t, e, n, a["values"], p)
                elif family == "set_repeated":
                    e = O.set_repeated(t, e, n, a["values"], p)
                elif family == "insert":
                    e = O.insert(t, e, bad, n, k, a["value"], p)
                elif family == "replace":
                    e = O.replace_(t, e, bad, n, k, a["value"])
                elif family == "remove":
                    e = O.remove(t, e, bad, n, k)
                else:
                    e = O.clear(e, n)
                W.fail(bad, O.BOUNDS)
            return W.serialise(e)

        return F.arrow_udf(_scalar(run), "binary")(self.source, *self.columns)


def edit(source) -> Edit:
    return Edit(source)


def build(fields: Sequence[tuple]) -> Column:
    """A message from columns: ``(n, type, column)`` each, an array column being a repeated field (packed where that is possible). A null leaves the field out."""
    plan = [(n, TYPES[t], c if isinstance(c, Column) else F.col(c)) for n, t, c in fields]
    types = [(n, t) for n, t, _ in plan]

    def run(*columns: pa.Array) -> pa.Array:
        """All fields' elements are gathered first and sorted once, by row and field."""
        rows = len(columns[0])
        parts = []  # (rows, field number, wire type, bits, payloads)
        for (number, t), c in zip(types, columns, strict=True):
            if pa.types.is_list(c.type) or pa.types.is_large_list(c.type):
                values, sizes = O._flat(c)
                row = np.repeat(np.arange(rows), sizes)
            else:
                there = np.asarray(c.is_valid())
                values, row, sizes = c.filter(pa.array(there)), np.flatnonzero(there), None
            u, payload = O._encode(t, values)
            if sizes is not None and t.packable:
                raw, size = W.encode_values(t.wire, u)
                per = np.bincount(row, size, rows).astype(np.int64)
                row = np.flatnonzero(sizes > 0)
                parts.append((row, number, LEN, np.zeros(len(row), np.uint64), W.binary(raw, (np.cumsum(per) - per)[row], per[row])))
            else:
                parts.append((row, number, t.wire, np.zeros(len(row), np.uint64) if u is None else u, payload))
        length = [len(x[0]) for x in parts]
        each = lambda k, kind: np.repeat(np.array([x[k] for x in parts], kind), length)
        off, size, data, base = [], [], [], 0
        for row, *_, payload in parts:
            raw, o = W.buffers(payload) if payload is not None else (np.zeros(0, np.uint8), np.zeros(len(row) + 1, np.int64))
            off.append(o[:-1] + base)
            size.append(np.diff(o))
            data.append(raw)
            base += len(raw)
        row = np.concatenate([x[0] for x in parts]).astype(np.int64)
        e = W.Elements(rows, row, np.zeros(len(row), np.int64), each(1, np.int64), each(2, np.int8), np.concatenate([x[3] for x in parts]), np.concatenate(off), np.concatenate(size), np.concatenate(data))
        return W.serialise(e.take(np.argsort(row, kind="stable")))

    return F.arrow_udf(_scalar(run), "binary")(*(c for _, _, c in plan))


__all__ = [
    "ELEMENTS", "MESSAGE", "WIRE_JSON", "add", "add_all", "as_json_array", "as_json_string_array", "build", "clear", "clear_repeated", "count", "edit", "element",
    "elements", "extract", "from_wire", "get", "get_repeated", "has", "insert", "new", "remove", "replace", "set", "set_repeated", "wire_json", "wire_json_new",
]
