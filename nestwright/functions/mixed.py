"""Values of any type in one column: VARIANT, in which SQL NULL is a missing field and the variant null a null.

Variants can't be compared, so comparisons, groups and sorts go by a key: the rank of the type, then the value.
"""

from __future__ import annotations

import datetime
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import VariantVal

#: Ranks by the type's name as schema_of_variant gives it (its first word).
_RANKS = ((5, ("VOID",)), (10, ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT", "INT", "SMALLINT", "TINYINT")), (15, ("STRING",)), (20, ("OBJECT",)), (25, ("ARRAY",)), (30, ("BINARY",)), (40, ("BOOLEAN",)), (45, ("TIMESTAMP_NTZ", "TIMESTAMP", "DATE")))
#: Types of the filter language by the same names; int and long are told apart by value.
TYPES = {"double": ("DOUBLE", "FLOAT"), "string": ("STRING",), "object": ("OBJECT",), "array": ("ARRAY",), "binData": ("BINARY",), "bool": ("BOOLEAN",), "date": ("TIMESTAMP_NTZ", "TIMESTAMP", "DATE"), "decimal": ("DECIMAL",), "null": ("VOID",), "number": ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT", "INT", "SMALLINT", "TINYINT")}


def is_mixed(t: T.DataType | None) -> bool:
    return isinstance(t, T.VariantType)


def kind(v: Column) -> Column:
    """Name of the value's type; null if it is missing."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z_]+", 0)


def rank_of(v: Column) -> Column:
    """Rank of the value's type; missing counts as null."""
    name, out = kind(v), F.lit(5)
    for n, names in _RANKS[1:]:
        out = F.when(name.isin(*names), n).otherwise(out)
    return F.when(v.isNull(), 5).otherwise(out)


def number(v: Column) -> Column:
    """The value as a double; null if it is none."""
    return F.when(rank_of(v) == 10, F.try_variant_get(v, "$", "double"))


def text(v: Column) -> Column:
    return F.when(rank_of(v) == 15, F.try_variant_get(v, "$", "string"))


def elements(v: Column) -> Column:
    """The members of an array; null for anything else."""
    return F.when(rank_of(v) == 25, F.try_variant_get(v, "$", "array<variant>"))


def is_null(v: Column) -> Column:
    """Null or missing."""
    return v.isNull() | F.is_variant_null(v)


def key(v: Column, numbers: bool = False) -> Column:
    """What orders values of all types; with `numbers` true and 1 are equal."""
    rank = rank_of(v)
    value = F.when(rank == 10, F.try_variant_get(v, "$", "double")).when(rank == 40, F.try_variant_get(v, "$", "boolean").cast("double"))
    whole = F.when(rank == 10, F.try_variant_get(v, "$", "bigint")).when(rank == 40, F.try_variant_get(v, "$", "boolean").cast("bigint")).when(rank == 45, F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.try_variant_get(v, "$", "timestamp_ntz")))
    words = F.when(rank == 15, F.try_variant_get(v, "$", "string")).when(rank.isin(20, 25), F.to_json(v)).when(rank == 30, F.hex(F.try_variant_get(v, "$", "binary")))
    return F.struct((F.when(rank == 40, 10).otherwise(rank) if numbers else rank).alias("rank"), value.alias("value"), whole.alias("whole"), words.alias("words"))


def member(v: Column, name: str, spread: bool) -> Column:
    """A member of an object; of an array the member by place or, with `spread`, those of its objects."""
    quoted = name.replace("\\", "\\\\").replace('"', '\\"')
    out = F.try_variant_get(v, f'$["{quoted}"]', "variant")
    if name.isdigit():
        return F.when(rank_of(v) == 25, F.get(elements(v), F.lit(int(name)))).otherwise(out)
    if not spread:
        return out
    of = F.filter(F.transform(elements(v), lambda x: F.try_variant_get(x, f'$["{quoted}"]', "variant")), lambda x: x.isNotNull())
    return F.when(rank_of(v) == 25, of.cast("variant")).otherwise(out)


def as_variant(col: Column, t: T.DataType | None) -> Column:
    """A typed value as a variant; a typed null is the variant null."""
    if is_mixed(t):
        return col
    null = F.parse_json(F.lit("null"))
    if t is None or isinstance(t, T.NullType):
        return null
    if isinstance(t, T.StructType | T.MapType):
        made = F.to_variant_object(col)
    elif isinstance(t, T.ArrayType):
        made = F.transform(col, lambda x: as_variant(x, t.elementType)).cast("variant")
    else:
        made = col.cast("variant")
    return F.when(col.isNull(), null).otherwise(made)


# Python values ------------------------------------------------------------------------------------


def encoded(value) -> VariantVal:
    """A Python value in the variant encoding; objects and arrays in its wide form."""
    names: list[str] = []

    def collect(x) -> None:
        names.extend(x if isinstance(x, dict) else ())
        for y in x.values() if isinstance(x, dict) else x if isinstance(x, list | tuple) else ():
            collect(y)

    collect(value)
    names = sorted(set(names))
    ids, raw = {n: i for i, n in enumerate(names)}, [n.encode() for n in names]
    ends = [0]
    for n in raw:
        ends.append(ends[-1] + len(n))
    return VariantVal(_value(value, ids), struct.pack(f"<BI{len(ends)}I", 0xC1, len(names), *ends) + b"".join(raw))


def _value(x, ids: dict[str, int]) -> bytes:
    if x is None:
        return b"\x00"
    if isinstance(x, bool):
        return b"\x04" if x else b"\x08"
    if isinstance(x, int):
        return struct.pack("<Bq", 0x18, x)
    if isinstance(x, float):
        return struct.pack("<Bd", 0x1C, x)
    if isinstance(x, datetime.datetime):
        past = x.replace(tzinfo=None) - datetime.datetime(1970, 1, 1)
        return struct.pack("<Bq", 0x34, (past.days * 86400 + past.seconds) * 10**6 + past.microseconds // 1000 * 1000)
    if isinstance(x, datetime.date):
        return struct.pack("<Bi", 0x2C, (x - datetime.date(1970, 1, 1)).days)
    if isinstance(x, str | bytes):
        raw = x.encode() if isinstance(x, str) else x
        return struct.pack("<BI", 0x40 if isinstance(x, str) else 0x3C, len(raw)) + raw
    if isinstance(x, dict):
        parts = [(ids[k], _value(v, ids)) for k, v in sorted(x.items(), key=lambda p: ids[p[0]])]
        return struct.pack(f"<BI{len(parts)}I", 0x7E, len(parts), *(i for i, _ in parts)) + _joined([v for _, v in parts])
    if isinstance(x, list | tuple):
        return struct.pack("<BI", 0x1F, len(x)) + _joined([_value(v, ids) for v in x])
    raise TypeError(f"values of {type(x).__name__} can't be stored")


def _joined(values: list[bytes]) -> bytes:
    ends = [0]
    for v in values:
        ends.append(ends[-1] + len(v))
    return struct.pack(f"<{len(ends)}I", *ends) + b"".join(values)


def literal(value) -> Column:
    """A Python value as a variant column, by its parts, since variants have no literals."""
    if value is None:
        return F.parse_json(F.lit("null"))
    if isinstance(value, dict):
        return F.to_variant_object(F.struct(*(literal(x).alias(k) for k, x in value.items()))) if value else F.parse_json(F.lit("{}"))
    if isinstance(value, list | tuple):
        return F.array(*map(literal, value)).cast("variant") if value else F.parse_json(F.lit("[]"))
    if isinstance(value, datetime.datetime):
        return F.lit(value.replace(tzinfo=None, microsecond=value.microsecond // 1000 * 1000).isoformat(" ")).cast("timestamp_ntz").cast("variant")
    return F.lit(value).cast("variant")


def plain(value):
    """A row's value as Python has it: variants decoded, missing members of a document left out."""
    if isinstance(value, VariantVal):
        return value.toPython()
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, list) else value


def document(row, types: T.StructType) -> dict:
    """A row as a document; a missing field of mixed type is left out."""
    values = row.asDict(recursive=True)
    return {f.name: plain(values[f.name]) for f in types if not (is_mixed(f.dataType) and values[f.name] is None)}
