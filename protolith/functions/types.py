"""The seventeen scalar types: wire type, Spark type, and bits to Arrow and back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VARINT, I64, LEN, SGROUP, EGROUP, I32 = range(6)
WIRE_NAMES = ("VARINT", "I64", "LEN", "SGROUP", "EGROUP", "I32")
U64 = pa.decimal128(20, 0)


class WireError(ValueError):
    """A message, index or value that an operator cannot accept."""


def decimal_from_bits(u: np.ndarray) -> pa.Array:
    wide = np.zeros((len(u), 2), np.uint64)
    wide[:, 0] = u
    return pa.Array.from_buffers(U64, len(u), [None, pa.py_buffer(wide.tobytes())])


def _zigzag(u: np.ndarray) -> np.ndarray:
    return ((u >> np.uint64(1)) ^ (np.uint64(0) - (u & np.uint64(1)))).view(np.int64)


def _unzigzag(v: np.ndarray) -> np.ndarray:
    return ((v << 1) ^ (v >> 63)).view(np.uint64)


def _finite(v: np.ndarray) -> pa.Array:
    return pa.array(v, mask=~np.isfinite(v))


@dataclass(frozen=True)
class ProtoType:
    name: str
    wire: int
    spark: str
    arrow: pa.DataType
    decode: Callable[[np.ndarray], pa.Array] | None
    encode: Callable[[np.ndarray], np.ndarray] | None
    low: int | None = None
    high: int | None = None
    zero: object = 0

    @property
    def packable(self) -> bool:
        return self.wire != LEN

    def out_of_range(self, u: np.ndarray) -> np.ndarray:
        """Which bits a narrow type cannot hold."""
        if self.name in ("int32", "enum"):
            v = u.view(np.int64)
        elif self.name == "sint32":
            v = _zigzag(u)
        elif self.name == "uint32":
            return u > np.uint64(0xFFFFFFFF)
        else:
            return np.zeros(len(u), bool)
        return (v < -(1 << 31)) | (v >= 1 << 31)

    def bits(self, values: pa.Array) -> np.ndarray:
        """Bits of Arrow values of any castable type. A null is an error, but NaN for float and double."""
        if values.null_count and self.name not in ("float", "double"):
            raise WireError(f"NULL is no {self.name} value")
        if self.arrow == U64:
            v = values.cast(pa.decimal128(38, 0)) if not pa.types.is_decimal(values.type) else values.cast(pa.decimal128(38, 0))
            raw = np.frombuffer(v.buffers()[1], np.uint64).reshape(-1, 2)[v.offset : v.offset + len(v)]
            if raw[:, 1].any():
                raise WireError(f"Value out of range for {self.name}")
            return raw[:, 0].copy()
        try:
            v = values.cast(self.arrow, safe=self.name not in ("float", "double"))
        except pa.ArrowInvalid as e:
            raise WireError(f"Value out of range for {self.name}") from e
        if self.name in ("float", "double"):
            v = v.fill_null(float("nan"))
        v = v.to_numpy(zero_copy_only=False)
        if self.low is not None and len(v) and (v.min() < self.low or v.max() > self.high):
            raise WireError(f"Value out of range for {self.name}")
        return self.encode(v)


def _t(name, wire, spark, arrow, decode=None, encode=None, low=None, high=None, zero=0) -> ProtoType:
    return ProtoType(name, wire, spark, arrow, decode, encode, low, high, zero)


_signed = lambda v: v.astype(np.int64).view(np.uint64)
_low32 = lambda u: u.astype(np.uint32)

TYPES: dict[str, ProtoType] = {
    t.name: t
    for t in (
        _t("int32", VARINT, "int", pa.int32(), lambda u: pa.array(u.view(np.int64).astype(np.int32)), _signed),
        _t("int64", VARINT, "bigint", pa.int64(), lambda u: pa.array(u.view(np.int64)), _signed),
        _t("uint32", VARINT, "bigint", pa.int64(), lambda u: pa.array(u.astype(np.int64)), _signed, 0, (1 << 32) - 1),
        _t("uint64", VARINT, "decimal(20,0)", U64, decimal_from_bits),
        _t("sint32", VARINT, "int", pa.int32(), lambda u: pa.array(_zigzag(u).astype(np.int32)), lambda v: _unzigzag(v.astype(np.int64))),
        _t("sint64", VARINT, "bigint", pa.int64(), lambda u: pa.array(_zigzag(u)), _unzigzag),
        _t("enum", VARINT, "int", pa.int32(), lambda u: pa.array(u.view(np.int64).astype(np.int32)), _signed),
        _t("bool", VARINT, "boolean", pa.bool_(), lambda u: pa.array(u != 0), lambda v: v.astype(np.uint64), zero=False),
        _t("fixed32", I32, "bigint", pa.int64(), lambda u: pa.array(u.astype(np.int64)), _signed, 0, (1 << 32) - 1),
        _t("sfixed32", I32, "int", pa.int32(), lambda u: pa.array(_low32(u).view(np.int32)), lambda v: v.view(np.uint32).astype(np.uint64)),
        _t("float", I32, "float", pa.float32(), lambda u: _finite(_low32(u).view(np.float32)), lambda v: v.astype(np.float32).view(np.uint32).astype(np.uint64), zero=0.0),
        _t("fixed64", I64, "decimal(20,0)", U64, decimal_from_bits),
        _t("sfixed64", I64, "bigint", pa.int64(), lambda u: pa.array(u.view(np.int64)), _signed),
        _t("double", I64, "double", pa.float64(), lambda u: _finite(u.view(np.float64)), lambda v: v.astype(np.float64).view(np.uint64), zero=0.0),
        _t("bytes", LEN, "binary", pa.binary(), zero=b""),
        _t("string", LEN, "string", pa.string(), zero=""),
        _t("message", LEN, "binary", pa.binary(), zero=b""),
    )
}
#: Integers that JSON arrays may carry as strings.
WIDE = ("int64", "uint64", "sint64", "fixed64", "sfixed64")


def to_bytes(t: ProtoType, values: pa.Array) -> pa.Array:
    """Payloads of values of a length-delimited type."""
    if values.null_count:
        raise WireError(f"NULL is no {t.name} value")
    if pa.types.is_string(values.type) or pa.types.is_large_string(values.type):
        return values.cast(pa.string()).cast(pa.binary())
    return values.cast(pa.binary())


def from_bytes(t: ProtoType, values: pa.Array) -> pa.Array:
    """Values of a length-delimited type from payloads; a string must be UTF-8."""
    if t.name != "string":
        return values
    try:
        return values.cast(pa.string())
    except pa.ArrowInvalid as e:
        raise WireError("Invalid UTF-8 in string field") from e


def valid_utf8(values: pa.Array) -> np.ndarray:
    def ok(b: bytes | None) -> bool:
        try:
            return b is None or b.decode("utf-8") is not None
        except UnicodeDecodeError:
            return False

    try:
        values.cast(pa.string())
        return np.ones(len(values), bool)
    except pa.ArrowInvalid:
        return np.array([ok(b) for b in values.to_pylist()], bool)


def null_where(values: pa.Array, mask: np.ndarray) -> pa.Array:
    return pc.if_else(pa.array(mask), pa.scalar(None, values.type), values) if mask.any() else values
