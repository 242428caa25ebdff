"""Bit utilities of the wire format as native expressions, IEEE bits through NumPy. Unsigned 64-bit values are raw longs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import TYPES, WIRE_NAMES, null_where

_HEX = lambda c, n: F.unhex(F.lpad(F.hex(c), n, "0"))


def bin_as_uint32(b: Column) -> Column:
    """Big-endian bytes, at most four, as an unsigned number."""
    wide = F.raise_error(F.lit("Binary value is longer than 4 bytes")).cast("bigint")
    return F.when(F.octet_length(b) > 4, wide).when(F.octet_length(b) == 0, F.lit(0).cast("bigint")).otherwise(F.conv(F.hex(b), 16, 10).cast("bigint"))


def bin_as_int32(b: Column) -> Column:
    """The same as a signed number."""
    v = bin_as_uint32(b)
    return F.when(v > 0x7FFFFFFF, v - (1 << 32)).otherwise(v).cast("int")


def bin_as_int64(b: Column) -> Column:
    """Big-endian bytes, at most eight, as a signed long: the raw bits of the unsigned number."""
    wide = F.raise_error(F.lit("Binary value is longer than 8 bytes")).cast("bigint")
    return F.when(F.octet_length(b) > 8, wide).when(F.octet_length(b) == 0, F.lit(0).cast("bigint")).otherwise(F.conv(F.hex(b), 16, -10).cast("bigint"))


def uint64_as_decimal(bits: Column) -> Column:
    """Raw bits as the unsigned number they stand for."""
    v = bits.cast("decimal(20,0)")
    return F.when(bits < 0, v + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(v).cast("decimal(20,0)")


def decimal_as_uint64(value: Column) -> Column:
    """An unsigned number as raw bits."""
    half = F.lit("9223372036854775808").cast("decimal(20,0)")
    return F.when(value >= half, (value - half - half).cast("bigint")).otherwise(value.cast("bigint"))


def uint64_as_int64(bits: Column) -> Column:
    return bits


int64_as_uint64 = uint64_as_int64


def uint32_as_int32(v: Column) -> Column:
    return F.when(v > 0x7FFFFFFF, v - (1 << 32)).otherwise(v).cast("int")


def int32_as_uint32(v: Column) -> Column:
    return v.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))


def uint64_as_uint32(bits: Column) -> Column:
    bad = F.raise_error(F.lit("Value out of range for uint32")).cast("bigint")
    return F.when((bits < 0) | (bits > 0xFFFFFFFF), bad).otherwise(bits)


def uint64_as_int32(bits: Column) -> Column:
    return uint32_as_int32(uint64_as_uint32(bits))


def int64_as_int32(v: Column) -> Column:
    bad = F.raise_error(F.lit("Value out of range for int32")).cast("int")
    return F.when((v < -(1 << 31)) | (v >= 1 << 31), bad).otherwise(v.cast("int"))


def zigzag_decode(bits: Column) -> Column:
    return F.shiftrightunsigned(bits, 1).bitwiseXOR(F.negate(bits.bitwiseAND(F.lit(1).cast("bigint"))))


def zigzag_encode(v: Column) -> Column:
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


uint64_as_sint64, sint64_as_uint64 = zigzag_decode, zigzag_encode


def _byte(bits: Column, k: int) -> Column:
    return F.shiftrightunsigned(bits, 8 * k).bitwiseAND(F.lit(0xFF).cast("bigint"))


def _swapped(bits: Column, size: int) -> Column:
    out = _byte(bits, size - 1)
    for k in range(size - 1):
        out = out.bitwiseOR(F.shiftleft(_byte(bits, k), 8 * (size - 1 - k)))
    return out


def swap_endian_32(v: Column) -> Column:
    return _swapped(v.cast("bigint"), 4)


def swap_endian_64(bits: Column) -> Column:
    return _swapped(bits, 8)


def _as(kind: str, spark: str):
    """A column through a kernel of ``types``: bits to a value or a value to bits. No native function reads IEEE bits."""
    t = TYPES[kind]

    def decode(bits: pa.Array) -> pa.Array:
        gone = np.asarray(bits.is_null())
        return null_where(t.decode(bits.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)), gone)

    def encode(x: pa.Array) -> pa.Array:
        return pa.array(t.bits(x).view(np.int64))

    return F.arrow_udf(encode if spark == "bigint" else decode, spark)


def uint64_as_double(bits: Column) -> Column:
    """Infinities and NaN read as null."""
    return _as("double", "double")(bits)


def uint32_as_float(bits: Column) -> Column:
    return _as("float", "float")(bits)


def double_as_uint64(x: Column) -> Column:
    """Null becomes NaN."""
    return _as("double", "bigint")(x)


def float_as_uint32(x: Column) -> Column:
    return _as("float", "bigint")(x)


def uint32_to_bin(v: Column) -> Column:
    return _HEX(v, 8)


def uint64_to_bin(bits: Column) -> Column:
    return _HEX(bits, 16)


def field_number(tag: Column) -> Column:
    return F.shiftright(tag, 3)


def wire_type(tag: Column) -> Column:
    return tag.bitwiseAND(F.lit(7).cast("bigint"))


def wire_type_name(t: Column) -> Column:
    out = F.raise_error(F.concat(F.lit("Unknown wire type "), t.cast("string"))).cast("string")
    for k, name in reversed(list(enumerate(WIRE_NAMES))):
        out = F.when(t == k, F.lit(name)).otherwise(out)
    return out
