"""Sample schemas, put together from short field lists: ``shop.Order``, and ``forms.Form`` with well-known types."""

from __future__ import annotations

from ..functions.descriptors import TYPE_CODES, Schema

_CODES = {name: code for code, name in TYPE_CODES.items()}


def field(text: str, oneof: int | None = None) -> dict:
    """``"number name type"`` with ``*`` behind the name of a repeated field; a type with a leading dot is a message, with ``#`` an enum."""
    n, name, kind = text.split()
    many, plain = name.endswith("*"), name.rstrip("*")
    head, *rest = plain.split("_")
    code = 14 if kind[0] == "#" else 11 if kind[0] == "." else _CODES[kind]
    out = {"1": plain, "3": int(n), "4": 3 if many else 1, "5": code}
    if code in (11, 14):
        out["6"] = kind.lstrip("#")
    if oneof is not None:
        out["9"] = oneof
    return out | {"10": head + "".join(map(str.title, rest))}


def message(name: str, *fields: dict | str, **more) -> dict:
    own = [field(f) if isinstance(f, str) else f for f in fields]
    return {"1": name, **({"2": own} if own else {}), **more}


def file(name: str, package: str, messages: list[dict], enums: list[dict] = (), needs: list[str] = ()) -> dict:
    out = {"1": name, "2": package, "3": list(needs), "4": messages, "5": list(enums), "12": "proto3"}
    return {k: v for k, v in out.items() if v}


def enum(name: str, *values: str) -> dict:
    return {"1": name, "2": [{"1": v, "2": k} for k, v in enumerate(values)]}


_G = ".google.protobuf."
_WRAPPED = {"Double": "double", "Float": "float", "Int64": "int64", "UInt64": "uint64", "Int32": "int32", "UInt32": "uint32", "Bool": "bool", "String": "string", "Bytes": "bytes"}
# The public well-known types, by name and number of their fields.
TIMESTAMP = file("google/protobuf/timestamp.proto", "google.protobuf", [message("Timestamp", "1 seconds int64", "2 nanos int32")])
KNOWN = file(
    "google/protobuf/known.proto", "google.protobuf",
    [
        message("Duration", "1 seconds int64", "2 nanos int32"), message("FieldMask", "1 paths* string"), message("Empty"),
        *(message(f"{k}Value", f"1 value {t}") for k, t in _WRAPPED.items()),
        message("Struct", f"1 fields* {_G}Struct.FieldsEntry", **{"3": [message("FieldsEntry", "1 key string", f"2 value {_G}Value", **{"7": {"7": True}})]}),
        message("ListValue", f"1 values* {_G}Value"),
        message(
            "Value", field(f"1 null_value #{_G}NullValue", 0), field("2 number_value double", 0), field("3 string_value string", 0),
            field("4 bool_value bool", 0), field(f"5 struct_value {_G}Struct", 0), field(f"6 list_value {_G}ListValue", 0), **{"8": [{"1": "kind"}]},
        ),
    ],
    [enum("NullValue", "NULL_VALUE")],
)
SHOP = file(
    "shop.proto", "shop",
    [message("Order", "1 order_key uint64", "2 status string", f"3 placed {_G}Timestamp", "4 lines* int32", "5 kind #.shop.Kind", "6 note string")],
    [enum("Kind", "KIND_UNSPECIFIED", "KIND_ONE")], ["google/protobuf/timestamp.proto"],
)
FORMS = file(
    "forms.proto", "forms",
    [
        message(
            "Form", f"1 took {_G}Duration", f"2 some_value {_G}Value", f"3 tags {_G}Struct", f"4 list {_G}ListValue", f"5 mask {_G}FieldMask", f"6 nothing {_G}Empty",
            *(f"{10 + k} w_{name.lower()} {_G}{name}Value" for k, name in enumerate(_WRAPPED)), f"20 at {_G}Timestamp",
        ),
        message(
            "Shape", "1 counts* .forms.Shape.CountsEntry", "2 kind #.forms.Kind", field("3 a_number int32", 0), field("4 a_word string", 0), {**field("5 maybe int32", 1), "17": True},
            **{"3": [message("CountsEntry", "1 key string", "2 value int32", **{"7": {"7": True}})], "8": [{"1": "pick"}, {"1": "_maybe"}]},
        ),
        message("Nation", "1 nation_key int32", "2 nation_name string", "3 region_key int64", "4 letters* string", "5 kind #.forms.Kind", "6 raw bytes", f"7 at {_G}Timestamp"),
    ],
    [enum("Kind", "KIND_UNSPECIFIED", "KIND_ONE")], ["google/protobuf/known.proto", "google/protobuf/timestamp.proto"],
)

ORDERS = Schema([TIMESTAMP, SHOP])
ORDERS_SET = ORDERS.to_json()
FORMS_SCHEMA = Schema([TIMESTAMP, KNOWN, FORMS])
