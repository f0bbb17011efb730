"""Canonical schema strings and their SHA-256."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..errors import EngineError

#: Names of fixed types in canonical strings: fixed values of the format.
_NAMES = {
    pa.null(): "null", pa.bool_(): "bool", pa.string(): "utf8", pa.large_string(): "large_utf8", pa.binary(): "binary", pa.large_binary(): "large_binary",
    pa.date32(): "date_day", pa.date64(): "date_ms", pa.float16(): "float16", pa.float32(): "float32", pa.float64(): "float64",
    pa.int8(): "int8s", pa.int16(): "int16s", pa.int32(): "int32s", pa.int64(): "int64s", pa.uint8(): "int8u", pa.uint16(): "int16u", pa.uint32(): "int32u", pa.uint64(): "int64u",
    pa.month_day_nano_interval(): "interval_mdn",
}


def _type(t: pa.DataType) -> tuple[str, list[pa.Field]]:
    """A type's name and its child fields."""
    if t in _NAMES:
        return _NAMES[t], []
    kind = pa.types
    if kind.is_decimal(t):
        return f"decimal{t.bit_width}_{t.precision}_{t.scale}", []
    if kind.is_timestamp(t):
        return f"timestamp_{t.unit}_{t.tz or ''}", []
    if kind.is_time(t):
        return f"time_{t.unit}_{t.bit_width}", []
    if kind.is_duration(t):
        return f"duration_{t.unit}", []
    if kind.is_fixed_size_binary(t):
        return f"fixed_size_binary_{t.byte_width}", []
    if kind.is_map(t):
        pair = pa.struct([t.key_field, t.item_field])
        return "map_sorted" if t.keys_sorted else "map_unsorted", [pa.field("entries", pair, nullable=False)]
    if kind.is_struct(t):
        return "struct", list(t)
    for test, name in ((kind.is_fixed_size_list, "fixed_size_list"), (kind.is_large_list, "large_list"), (kind.is_list, "list")):
        if test(t):
            return f"{name}_{t.list_size}" if name == "fixed_size_list" else name, [t.value_field]
    raise EngineError("unsupported_type", str(t))


def canonical(schema: pa.Schema) -> str:
    def one(field: pa.Field) -> str:
        name, children = _type(field.type)
        inner = f"<{';'.join(map(one, children))}>" if children else ""
        return f"{field.name}|{name}|{'null' if field.nullable else 'nonnull'}{inner}"

    return "\n".join(map(one, schema))


def fingerprint(schema: pa.Schema) -> str:
    return hashlib.sha256(canonical(schema).encode()).hexdigest()


_ARROW = {
    T.StringType: pa.string(), T.BooleanType: pa.bool_(), T.ByteType: pa.int8(), T.ShortType: pa.int16(), T.IntegerType: pa.int32(), T.LongType: pa.int64(),
    T.FloatType: pa.float32(), T.DoubleType: pa.float64(), T.BinaryType: pa.binary(), T.DateType: pa.date32(), T.TimestampType: pa.timestamp("us", "UTC"), T.TimestampNTZType: pa.timestamp("us"), T.NullType: pa.null(),
}


def arrow_type(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.DecimalType):
        return pa.decimal128(t.precision, t.scale)
    if isinstance(t, T.ArrayType):
        return pa.list_(pa.field("item", arrow_type(t.elementType), t.containsNull))
    if isinstance(t, T.MapType):
        return pa.map_(arrow_type(t.keyType), pa.field("value", arrow_type(t.valueType), t.valueContainsNull))
    if isinstance(t, T.StructType):
        return pa.struct([pa.field(f.name, arrow_type(f.dataType), f.nullable) for f in t])
    if type(t) not in _ARROW:
        raise EngineError("unsupported_type", t.simpleString())
    return _ARROW[type(t)]


def of_frame(df: DataFrame) -> str:
    """From the schema alone; nothing is run."""
    return fingerprint(pa.schema([pa.field(f.name, arrow_type(f.dataType), f.nullable) for f in df.schema]))
