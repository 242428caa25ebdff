"""Whole-message operators on DataFrames: decode, encode, materialise, gather."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import ops as O
from ..functions import pb
from ..functions import wire as W
from ..functions.descriptors import Field, Schema
from ..functions.types import TYPES, WIDE

TIMESTAMP = ".google.protobuf.Timestamp"


def _decode(schema: Schema, name: str, column: pa.Array, depth: int, valid: np.ndarray | None = None) -> pa.StructArray:
    m = schema.message(name)
    e, bad = W.parse(column)
    rows = len(column)
    out = []
    for f in m.fields:
        t, n = TYPES[f.kind], np.full(rows, f.number)
        entry = schema.messages.get(f.type_name) if f.kind == "message" else None
        nest = (lambda x, f=f: _decode(schema, f.type_name, x, depth - 1, np.asarray(x.is_valid()))) if f.kind == "message" and depth > 1 else (lambda x: x)
        if entry is not None and entry.map_entry:
            lists = O.repeated(t, e, bad, n)
            pairs = _decode(schema, f.type_name, lists.flatten(), depth)
            kf, vf = (next(x.name for x in entry.fields if x.number == k) for k in (1, 2))
            keys, values = pairs.field(kf), pairs.field(vf)
            keys = keys.fill_null(TYPES[entry.by_number[1].kind].zero) if keys.null_count else keys
            first = lists.offsets.to_numpy()
            row = np.repeat(np.arange(rows), np.diff(first))
            code = keys.dictionary_encode().indices.to_numpy()
            order = np.lexsort((code, row))  # stable: entries of a key stay in order, and the last wins
            new = np.r_[(row[order][1:] != row[order][:-1]) | (code[order][1:] != code[order][:-1]), np.ones(min(1, len(row)), bool)]
            keep = np.sort(order[new])
            ends = np.r_[0, np.cumsum(np.bincount(row[keep], minlength=rows))].astype(np.int32)
            out.append(pa.MapArray.from_arrays(pa.array(ends), keys.take(pa.array(keep)), values.take(pa.array(keep))))
        elif f.repeated:
            lists = O.repeated(t, e, bad, n)
            out.append(pa.ListArray.from_arrays(lists.offsets, nest(lists.flatten())))
        else:
            zero = None if f.presence else pa.array([t.zero] * rows, pa.int64() if t.arrow == pa.decimal128(20, 0) else t.arrow)
            out.append(nest(O.get(t, e, bad, n, zero)))
    W.fail(bad)
    mask = None if valid is None or valid.all() else pa.array(~valid)
    return pa.StructArray.from_arrays(out, [f.name for f in m.fields], mask=mask)


def from_message(schema: Schema, name: str, source, depth: int = 8) -> Column:
    """A message as a struct. Presence fields are null when absent, others have their default; null messages are null."""
    kind = schema.struct_type(name, depth)
    text, arrow = schema.to_json(), to_arrow_type(_parse_datatype_string(kind))

    def run(column: pa.Array) -> pa.Array:
        out = _decode(Schema.from_json(text), name, column, depth, np.asarray(column.is_valid()))
        return out.cast(arrow)

    return F.arrow_udf(run, kind).asNondeterministic()(F.col(source) if isinstance(source, str) else source)


def decode(df: DataFrame, column: str, schema: Schema, name: str, depth: int = 8) -> DataFrame:
    """``df`` with the message column replaced by its fields' columns. Filter plain columns before."""
    held = f"__{column}"
    rest = [c for c in df.columns if c != column]
    return df.withColumn(held, from_message(schema, name, column, depth)).select(*rest, f"{held}.*")


def _encode(schema: Schema, name: str, column: pa.StructArray) -> pa.Array:
    m = schema.message(name)
    rows = len(column)
    e, _ = W.parse(pa.array([b""] * rows, pa.binary()))
    names = [column.type.field(k).name for k in range(column.type.num_fields)]
    for f in m.fields:
        if f.name not in names:
            continue
        t, n, x = TYPES[f.kind], np.full(rows, f.number), column.field(names.index(f.name))
        entry = schema.messages.get(f.type_name) if f.kind == "message" else None
        nest = (lambda v, f=f: _encode(schema, f.type_name, v)) if f.kind == "message" and not pa.types.is_binary(x.type) else (lambda v: v)
        if entry is not None and entry.map_entry and pa.types.is_map(x.type):
            kf, vf = (next(y.name for y in entry.fields if y.number == k) for k in (1, 2))
            pairs = pa.StructArray.from_arrays([x.keys, x.items], [kf, vf])
            lists = pa.ListArray.from_arrays(x.offsets, _encode(schema, f.type_name, pairs))
            e = O.extend(t, e, n, lists, np.zeros(rows, bool))
        elif f.repeated:
            inner = x.flatten()
            sizes = np.asarray(x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            e = O.append_all(t, e, n, nest(inner) if f.kind == "message" else inner, sizes, np.full(rows, t.packable))
        else:
            there = np.asarray(x.is_valid())
            if not f.presence and t.name not in ("message",):
                zero = pa.array([t.zero] * rows, pa.int64()).cast(x.type) if pa.types.is_decimal(x.type) else pa.array([t.zero] * rows, x.type)
                same = pa.compute.equal(x, zero).fill_null(False)
                there &= ~np.asarray(same)
            flat = x.filter(pa.array(there))
            e = O.append_all(t, e, n, nest(flat) if f.kind == "message" else flat, there.astype(np.int64), np.zeros(rows, bool))
    return W.serialise(e)


def to_message(schema: Schema, name: str, source) -> Column:
    """A struct as a message. Nulls and implicit defaults are left out; repeated scalars are packed."""
    text = schema.to_json()

    def run(column: pa.Array) -> pa.Array:
        return _encode(Schema.from_json(text), name, column)

    return F.arrow_udf(run, "binary")(F.col(source) if isinstance(source, str) else source)


def materialise(df: DataFrame, column: str, fields: dict[str, tuple]) -> DataFrame:
    """``df`` with extracted columns beside the message. Written as Parquet, filters on them reach the scan."""
    held = "__extracted"
    return df.withColumn(held, pb.extract(column, fields)).select(*df.columns, f"{held}.*")


def gather(df: DataFrame, keys: list[str], order: str, n: int, type_name: str, value: str, packed: bool = True, alias: str = "message", count: str | None = None, once: bool = False) -> DataFrame:
    """One message per group with ``value`` as its repeated field ``n``, in the order of ``order``. ``count`` names a column with the number of values; ``once`` as in ``pb``."""
    counted = [F.count("*").cast("int").alias(count)] if count else []
    lists = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("l"), *counted)
    values = F.transform("l", lambda x: x["v"])
    return lists.select(*keys, *([count] if count else []), pb.set_repeated(pb.new(), n, type_name, values, packed=packed, once=once).alias(alias))


def unique_violations(df: DataFrame, column: str, fields: dict[str, tuple]) -> DataFrame:
    """Values of extracted fields that more than one message has, with their number: what a unique index would refuse."""
    return materialise(df.select(column), column, fields).groupBy(*fields).agg(F.count("*").alias("n")).where("n > 1")


def zero_merged(keys: DataFrame, key: str, *counts: DataFrame) -> DataFrame:
    """All ``keys`` with the columns of ``counts``, 0 where a key is absent."""
    for c in counts:
        keys = keys.join(c, key, "left")
    return keys.fillna(0, [x for c in counts for x in c.columns if x != key])


def self_time(spans: DataFrame, span: str, parent: str, took: str) -> DataFrame:
    """``id``, ``took`` and ``own``: a span's time without that of the spans it calls directly."""
    inner = spans.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias(span)).agg(F.sum(took).alias("inner"))
    return spans.join(inner, span, "left").select(span, took, (F.col(took) - F.coalesce("inner", F.lit(0))).alias("own"))


def which_oneof(source, members: dict[str, int]) -> Column:
    """The name of the oneof member that comes last on the wire, or null."""
    hit = F.filter(pb.elements(source), lambda e: e["n"].isin(*members.values()))
    names = F.create_map(*(F.lit(x) for name, n in members.items() for x in (n, name)))
    return F.element_at(names, F.try_element_at(hit, F.lit(-1))["n"])


def map_value(entries: Column, key) -> Column:
    """The value of a decoded map's key, or null."""
    return F.try_element_at(entries, F.lit(key))


def where_element(source, n: int, fields: dict[str, tuple], key: str, value) -> Column:
    """The last element of a repeated message field whose ``key`` field has a value, as a struct of ``fields``, or null.

    All elements of a batch are parsed in one pass, whatever message they are in.
    """
    plan = [(name, number, TYPES[t], default) for name, (number, t, default) in fields.items()]
    schema = "array<struct<" + ",".join(f"`{name}`:{t.spark}" for name, _, t, _ in plan) + ">>"

    def run(column: pa.Array) -> pa.Array:
        e, bad = W.parse(column)
        lists = O.repeated(TYPES["message"], e, bad, np.full(len(column), n))
        W.fail(bad)
        inner, wrong = W.parse(lists.flatten())
        rows = inner.rows
        parts = [O.get(t, inner, wrong, np.full(rows, number), pa.array([default] * rows, None if rows else t.arrow)) for _, number, t, default in plan]
        W.fail(wrong)
        return pa.ListArray.from_arrays(lists.offsets, pa.StructArray.from_arrays(parts, [name for name, *_ in plan]))

    elements = F.arrow_udf(run, schema)(F.col(source) if isinstance(source, str) else source)
    return F.try_element_at(F.filter(elements, lambda x: x[key] == F.lit(value)), F.lit(-1))


def _json_kind(schema: Schema, f: Field) -> str:
    """The Spark type as which a field's JSON is read: what JSON writes as text is text."""
    if f.kind == "message":
        return "string" if f.type_name == TIMESTAMP else _json_type(schema, f.type_name)
    return "string" if f.kind in (*WIDE, "enum", "bytes", "string") else TYPES[f.kind].spark


def _json_type(schema: Schema, name: str) -> str:
    kinds = [(f, _json_kind(schema, f)) for f in schema.message(name).fields]
    return "struct<" + ",".join(f"`{f.json_name}`:" + (f"array<{k}>" if f.repeated else k) for f, k in kinds) + ">"


def _from_json(schema: Schema, f: Field, x: Column) -> Column:
    if f.kind == "message" and f.type_name == TIMESTAMP:
        digits = F.rpad(F.regexp_extract(x, r"\.(\d{1,9})", 1), 9, "0")
        whole = F.unix_seconds(F.regexp_replace(x, r"\.\d+", "").cast("timestamp"))
        return F.when(x.isNotNull(), F.struct(whole.alias("seconds"), digits.cast("int").alias("nanos")))
    if f.kind == "message":
        inner = [_from_json_field(schema, g, x).alias(g.name) for g in schema.message(f.type_name).fields]
        return F.when(x.isNotNull(), F.struct(*inner))
    if f.kind == "bytes":
        return F.unbase64(x)
    if f.kind == "enum":
        names = schema.enums.get(f.type_name, {})
        known = F.create_map(*(F.lit(v) for number, name in names.items() for v in (name, number)))
        return F.coalesce(F.try_element_at(known, x), x.try_cast("int"))
    return x.cast(TYPES[f.kind].spark)


def _from_json_field(schema: Schema, f: Field, source: Column) -> Column:
    x = source[f.json_name]
    return F.transform(x, lambda v: _from_json(schema, f, v)) if f.repeated else _from_json(schema, f, x)


def from_json_text(schema: Schema, name: str, source) -> Column:
    """A message from ProtoJSON text, by native JSON parsing and ``to_message``.

    For messages of scalars, enums (by name or number), Timestamps and messages of these. Unknown keys are passed over, a null is
    an absent field, and a text that is no JSON object gives null.
    """
    kind = _json_type(schema, name).removesuffix(">")
    read = F.from_json(F.col(source) if isinstance(source, str) else source, f"{kind}{',' if kind[-1] != '<' else ''}`__bad`:string>", {"columnNameOfCorruptRecord": "__bad"})
    fields = [_from_json_field(schema, f, read).alias(f.name) for f in schema.message(name).fields]
    return F.when(read.isNotNull() & read["__bad"].isNull(), to_message(schema, name, F.struct(*fields)))
