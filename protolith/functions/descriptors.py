"""Schemas from FileDescriptorSet bytes, decoded by this package's own reader.

``Schema.from_descriptor_set(data)`` needs no protobuf runtime. ``to_json`` gives the
interchange form ``[1, FileDescriptorSet as number-JSON, type index]`` and
``from_json`` reads it back.
"""

from __future__ import annotations

import base64
import json
import struct
from dataclasses import dataclass, field

from .types import TYPES, WireError

# Type codes and labels of field descriptors.
TYPE_CODES = {1: "double", 2: "float", 3: "int64", 4: "uint64", 5: "int32", 6: "fixed64", 7: "fixed32", 8: "bool", 9: "string", 10: "group", 11: "message", 12: "bytes", 13: "uint32", 14: "enum", 15: "sfixed32", 16: "sfixed64", 17: "sint32", 18: "sint64"}
REPEATED, MESSAGE, ENUM = 3, 11, 14

# Descriptor.proto, a message per line with "number name type"; * marks a repeated field.
DESCRIPTOR_PROTO = """
FileDescriptorSet: 1 file* FileDescriptorProto
FileDescriptorProto: 1 name string, 2 package string, 3 dependency* string, 4 message_type* DescriptorProto, 5 enum_type* EnumDescriptorProto, 6 service* ServiceDescriptorProto, 7 extension* FieldDescriptorProto, 8 options FileOptions, 9 source_code_info SourceCodeInfo, 10 public_dependency* int32, 11 weak_dependency* int32, 12 syntax string, 14 edition enum, 15 option_dependency* string
DescriptorProto: 1 name string, 2 field* FieldDescriptorProto, 3 nested_type* DescriptorProto, 4 enum_type* EnumDescriptorProto, 5 extension_range* ExtensionRange, 6 extension* FieldDescriptorProto, 7 options MessageOptions, 8 oneof_decl* OneofDescriptorProto, 9 reserved_range* ReservedRange, 10 reserved_name* string
ExtensionRange: 1 start int32, 2 end int32, 3 options ExtensionRangeOptions
ReservedRange: 1 start int32, 2 end int32
EnumReservedRange: 1 start int32, 2 end int32
FieldDescriptorProto: 1 name string, 2 extendee string, 3 number int32, 4 label enum, 5 type enum, 6 type_name string, 7 default_value string, 8 options FieldOptions, 9 oneof_index int32, 10 json_name string, 17 proto3_optional bool
OneofDescriptorProto: 1 name string, 2 options OneofOptions
EnumDescriptorProto: 1 name string, 2 value* EnumValueDescriptorProto, 3 options EnumOptions, 4 reserved_range* EnumReservedRange, 5 reserved_name* string
EnumValueDescriptorProto: 1 name string, 2 number int32, 3 options EnumValueOptions
ServiceDescriptorProto: 1 name string, 2 method* MethodDescriptorProto, 3 options ServiceOptions
MethodDescriptorProto: 1 name string, 2 input_type string, 3 output_type string, 4 options MethodOptions, 5 client_streaming bool, 6 server_streaming bool
FileOptions: 1 java_package string, 8 java_outer_classname string, 9 optimize_for enum, 10 java_multiple_files bool, 11 go_package string, 16 cc_generic_services bool, 17 java_generic_services bool, 18 py_generic_services bool, 20 java_generate_equals_and_hash bool, 23 deprecated bool, 27 java_string_check_utf8 bool, 31 cc_enable_arenas bool, 36 objc_class_prefix string, 37 csharp_namespace string, 39 swift_prefix string, 40 php_class_prefix string, 41 php_namespace string, 44 php_metadata_namespace string, 45 ruby_package string, 50 features FeatureSet, 999 uninterpreted_option* UninterpretedOption
MessageOptions: 1 message_set_wire_format bool, 2 no_standard_descriptor_accessor bool, 3 deprecated bool, 7 map_entry bool, 11 deprecated_legacy_json_field_conflicts bool, 12 features FeatureSet, 999 uninterpreted_option* UninterpretedOption
FieldOptions: 1 ctype enum, 2 packed bool, 3 deprecated bool, 5 lazy bool, 6 jstype enum, 10 weak bool, 15 unverified_lazy bool, 16 debug_redact bool, 17 retention enum, 19 targets* enum, 20 edition_defaults* EditionDefault, 21 features FeatureSet, 22 feature_support FeatureSupport, 999 uninterpreted_option* UninterpretedOption
EditionDefault: 2 value string, 3 edition enum
FeatureSupport: 1 edition_introduced enum, 2 edition_deprecated enum, 3 deprecation_warning string, 4 edition_removed enum
OneofOptions: 1 features FeatureSet, 999 uninterpreted_option* UninterpretedOption
EnumOptions: 2 allow_alias bool, 3 deprecated bool, 6 deprecated_legacy_json_field_conflicts bool, 7 features FeatureSet, 999 uninterpreted_option* UninterpretedOption
EnumValueOptions: 1 deprecated bool, 2 features FeatureSet, 3 debug_redact bool, 4 feature_support FeatureSupport, 999 uninterpreted_option* UninterpretedOption
ServiceOptions: 33 deprecated bool, 34 features FeatureSet, 999 uninterpreted_option* UninterpretedOption
MethodOptions: 33 deprecated bool, 34 idempotency_level enum, 35 features FeatureSet, 999 uninterpreted_option* UninterpretedOption
ExtensionRangeOptions: 2 declaration* Declaration, 3 verification enum, 50 features FeatureSet, 999 uninterpreted_option* UninterpretedOption
Declaration: 1 number int32, 2 full_name string, 3 type string, 5 reserved bool, 6 repeated bool
FeatureSet: 1 field_presence enum, 2 enum_type enum, 3 repeated_field_encoding enum, 4 utf8_validation enum, 5 message_encoding enum, 6 json_format enum, 7 enforce_naming_style enum, 8 default_symbol_visibility enum
UninterpretedOption: 2 name* NamePart, 3 identifier_value string, 4 positive_int_value uint64, 5 negative_int_value int64, 6 double_value double, 7 string_value bytes, 8 aggregate_value string
NamePart: 1 name_part string, 2 is_extension bool
SourceCodeInfo: 1 location* Location
Location: 1 path* int32, 2 span* int32, 3 leading_comments string, 4 trailing_comments string, 6 leading_detached_comments* string
"""


def fields(data: bytes):
    """(number, wire type, value) of one message; bytes for LEN, unsigned bits else."""
    pos, end = 0, len(data)

    def varint() -> int:
        nonlocal pos
        out = shift = 0
        while True:
            if pos >= end:
                raise WireError("Unexpected end of BLOB")
            if shift > 63:
                raise WireError("Varint is longer than 10 bytes")
            b = data[pos]
            pos += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out & 0xFFFFFFFFFFFFFFFF

    while pos < end:
        tag = varint()
        n, t = tag >> 3, tag & 7
        if not 1 <= n < 1 << 29:
            raise WireError("Invalid field number")
        if t == 0:
            yield n, t, varint()
            continue
        size = varint() if t == 2 else {1: 8, 5: 4}.get(t)
        if size is None:
            raise WireError(f"Unsupported wire type {t}")
        if pos + size > end:
            raise WireError("Unexpected end of BLOB")
        raw, pos = data[pos : pos + size], pos + size
        yield n, t, raw if t == 2 else int.from_bytes(raw, "little")


def scalar(kind: str, v):
    """A Python value from bits or payload."""
    if isinstance(v, bytes):
        if kind == "string":
            try:
                return v.decode("utf-8")
            except UnicodeDecodeError as e:
                raise WireError("Invalid UTF-8 in string field") from e
        return v
    if kind in ("sint32", "sint64"):
        return (v >> 1) ^ -(v & 1)
    if kind in ("int32", "enum"):
        v &= 0xFFFFFFFF
        return v - (1 << 32) if v >> 31 else v
    if kind in ("int64", "sfixed64"):
        return v - (1 << 64) if v >> 63 else v
    if kind == "sfixed32":
        return v - (1 << 32) if v >> 31 else v
    if kind == "uint32":
        return v & 0xFFFFFFFF
    if kind == "bool":
        return v != 0
    if kind == "float":
        return struct.unpack("<f", v.to_bytes(4, "little"))[0]
    return struct.unpack("<d", v.to_bytes(8, "little"))[0] if kind == "double" else v


def unpacked(kind: str, t: int, v):
    """The values of one wire element of a repeated field."""
    wire = TYPES[kind].wire if kind in TYPES else 2
    if t != 2 or wire == 2:
        return [scalar(kind, v)]
    if wire == 0:
        out, cur, shift = [], 0, 0
        for b in v:
            cur |= (b & 127) << shift
            shift += 7
            if b < 128:
                out.append(scalar(kind, cur & 0xFFFFFFFFFFFFFFFF))
                cur = shift = 0
        if shift:
            raise WireError("Unexpected end of BLOB")
        return out
    size = 8 if wire == 1 else 4
    if len(v) % size:
        raise WireError("Unexpected end of BLOB")
    return [scalar(kind, int.from_bytes(v[k : k + size], "little")) for k in range(0, len(v), size)]


def _own() -> dict[str, dict[int, tuple[bool, str]]]:
    out = {}
    for line in DESCRIPTOR_PROTO.strip().splitlines():
        name, rest = line.split(": ")
        out[name] = {int(n): (label.endswith("*"), kind) for n, label, kind in (f.split() for f in rest.split(", "))}
    return out


_OWN = _own()


def number_json(name: str, data: bytes, source_info: bool = False) -> dict:
    """A message of descriptor.proto as number-JSON: set fields alone, in number order."""
    out: dict[int, object] = {}
    for n, t, v in fields(data):
        if n not in _OWN[name] or (name == "FileDescriptorProto" and n == 9 and not source_info):
            continue
        many, kind = _OWN[name][n]
        values = [number_json(kind, v, source_info)] if kind in _OWN else [base64.b64encode(x).decode() if isinstance(x, bytes) else x for x in unpacked(kind, t, v)]
        if many:
            out.setdefault(n, []).extend(values)
        else:
            out[n] = values[-1]
    return {str(n): out[n] for n in sorted(out)}


def _varint(v: int) -> bytes:
    out = bytearray()
    v &= 0xFFFFFFFFFFFFFFFF
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    return bytes((*out, v))


def from_number_json(name: str, d: dict) -> bytes:
    """A message of descriptor.proto from its number-JSON: ``number_json`` backwards."""
    out = b""
    for key in sorted(d, key=int):
        n, (many, kind) = int(key), _OWN[name][int(key)]
        for v in d[key] if many else [d[key]]:
            if kind in _OWN or kind in ("string", "bytes"):
                data = from_number_json(kind, v) if kind in _OWN else v.encode() if kind == "string" else base64.b64decode(v)
                out += _varint(n << 3 | 2) + _varint(len(data)) + data
            elif kind == "double":
                out += _varint(n << 3 | 1) + struct.pack("<d", v)
            else:
                out += _varint(n << 3) + _varint(int(v))
    return out


@dataclass
class Field:
    number: int
    name: str
    json_name: str
    kind: str
    type_name: str = ""
    repeated: bool = False
    presence: bool = False
    oneof: int | None = None


@dataclass
class Message:
    name: str
    fields: list[Field] = field(default_factory=list)
    oneofs: list[str] = field(default_factory=list)
    map_entry: bool = False

    def __post_init__(self):
        self.by_number = {f.number: f for f in self.fields}


def lower_camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x[:1].upper() + x[1:] for x in rest)


class Schema:
    """Messages and enums by full name with a leading dot."""

    def __init__(self, files: list[dict]):
        self.files = files
        self.messages: dict[str, Message] = {}
        self.enums: dict[str, dict[int, str]] = {}
        self.index: dict[str, list] = {}
        for k, f in enumerate(files):
            at, prefix = f'$[1]."1"[{k}]', f".{f['2']}" if f.get("2") else ""
            for j, m in enumerate(f.get("4", [])):
                self._message(m, prefix, at, f'{at}."4"[{j}]', f.get("12") or "proto2")
            for j, m in enumerate(f.get("5", [])):
                self._enum(m, prefix, at, f'{at}."5"[{j}]')

    def _enum(self, d: dict, prefix: str, file: str, at: str) -> None:
        name = f"{prefix}.{d.get('1', '')}"
        values: dict[int, str] = {}
        for v in d.get("2", []):
            values.setdefault(v.get("2", 0), v.get("1", ""))
        self.enums[name], self.index[name] = values, [ENUM, file, at]

    def _message(self, d: dict, prefix: str, file: str, at: str, syntax: str) -> None:
        name = f"{prefix}.{d.get('1', '')}"
        self.index[name] = [MESSAGE, file, at]
        out = []
        for f in d.get("2", []):
            kind = TYPE_CODES[f.get("5", 5)]
            many = f.get("4") == REPEATED
            oneof = f.get("9") if not f.get("17") else None
            presence = not many and (syntax == "proto2" or kind == "message" or "9" in f)
            out.append(Field(f.get("3", 0), f.get("1", ""), f.get("10") or lower_camel(f.get("1", "")), kind, f.get("6", ""), many, presence, oneof))
        self.messages[name] = Message(name, out, [o.get("1", "") for o in d.get("8", [])], bool(d.get("7", {}).get("7")))
        for j, m in enumerate(d.get("3", [])):
            self._message(m, name, file, f'{at}."3"[{j}]', syntax)
        for j, m in enumerate(d.get("4", [])):
            self._enum(m, name, file, f'{at}."4"[{j}]')

    @classmethod
    def from_descriptor_set(cls, data: bytes, source_info: bool = False) -> Schema:
        return cls(number_json("FileDescriptorSet", bytes(data), source_info).get("1", []))

    def to_descriptor_set(self) -> bytes:
        return from_number_json("FileDescriptorSet", {"1": self.files} if self.files else {})

    @classmethod
    def from_json(cls, text: str) -> Schema:
        version, files, _ = json.loads(text)
        if version != 1:
            raise WireError(f"unknown descriptor set version {version}")
        return cls(files.get("1", []))

    def to_json(self) -> str:
        return json.dumps([1, {"1": self.files} if self.files else {}, self.index], separators=(",", ":"), ensure_ascii=False)

    def message(self, name: str) -> Message:
        if name not in self.messages:
            raise WireError(f"message type `{name}` not found in descriptor set")
        return self.messages[name]

    def struct_type(self, name: str, depth: int = 8) -> str:
        """The Spark type of a message as DDL; recursion is cut at ``depth`` and stays binary there."""
        m = self.message(name)
        cols = []
        for f in m.fields:
            entry = self.messages.get(f.type_name) if f.kind == "message" else None
            if entry is not None and entry.map_entry:
                kinds = [self._kind(x, depth) for x in sorted(entry.fields, key=lambda x: x.number)]
                cols.append(f"`{f.name}`:map<{kinds[0]},{kinds[1]}>")
            else:
                kind = self._kind(f, depth)
                cols.append(f"`{f.name}`:{f'array<{kind}>' if f.repeated else kind}")
        return f"struct<{','.join(cols)}>"

    def _kind(self, f: Field, depth: int) -> str:
        if f.kind == "message":
            return self.struct_type(f.type_name, depth - 1) if depth > 1 else "binary"
        return TYPES[f.kind].spark
