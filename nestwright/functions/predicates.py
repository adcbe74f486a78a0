"""The filter language compiled to Columns. A filter may be null where it is false, so that plain comparisons reach the
scan as they are; every negation inside makes its operand two-valued first, and so must callers that negate a filter."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestwright.errors import OperationFailure
from nestwright.functions import mixed
from nestwright.functions.expressions import Env, Val, compile_expression, flags, literal, rank, same, step, truth
from nestwright.functions.mixed import is_mixed

UNSUPPORTED = set("$where $text $jsonSchema $bitsAllClear $bitsAllSet $bitsAnyClear $bitsAnySet $geoIntersects $geoWithin $maxDistance $minDistance $near $nearSphere".split())
_TYPES = {"double": T.DoubleType, "string": T.StringType, "object": (T.StructType, T.MapType), "array": T.ArrayType, "binData": T.BinaryType, "bool": T.BooleanType, "date": (T.TimestampNTZType, T.TimestampType, T.DateType), "int": (T.IntegerType, T.ShortType, T.ByteType), "long": T.LongType, "decimal": T.DecimalType, "number": T.NumericType}


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def compile_filter(spec: dict, env: Env) -> Column:
    out = F.lit(True)
    for key, s in spec.items():
        if key == "$comment":
            continue
        if key in UNSUPPORTED:
            raise NotImplementedError(f"the filter operator {key} is not supported")
        if key in ("$and", "$or", "$nor"):
            if not isinstance(s, list | tuple) or not s:
                raise OperationFailure(f"{key} needs a list that isn't empty")
            parts = [compile_filter(x, env) for x in s]
            one = parts[0]
            for p in parts[1:]:
                one = one & p if key == "$and" else one | p
            out = out & (~sure(one) if key == "$nor" else one)
        elif key == "$expr":
            out = out & truth(compile_expression(s, env))
        elif key.startswith("$"):
            raise OperationFailure(f"unknown top level operator: {key}")
        else:
            head, *rest = key.split(".")
            names = {f.name: f.dataType for f in env.frame.schema}
            v = Val(F.col(f"`{head}`"), names[head]) if head in names else Val(None)
            out = out & at_path(v, rest, s, env)
    return out


def at_path(v: Val, rest: list[str], s, env: Env, below: bool = False) -> Column:
    """Some candidate of the path satisfies s (with $ne and $nin: every one does)."""
    negative = isinstance(s, dict) and s and all(k.startswith("$") for k in s) and bool({"$ne", "$nin"} & set(s))
    if v.missing or not rest:
        return tested(v, s, env)
    name, more = rest[0], rest[1:]
    if isinstance(v.type, T.ArrayType) and not re.fullmatch(r"\d+", name):
        if not isinstance(v.type.elementType, T.StructType | T.MapType):
            return F.lit(negative)
        each = lambda x: at_path(Val(x, v.type.elementType), rest, s, env)
        if negative:
            return F.coalesce(F.forall(v.col, lambda x: sure(each(x))), F.lit(True))
        if isinstance(s, dict) and set(s) == {"$exists"} and not s["$exists"]:
            return F.coalesce(F.exists(v.col, each), F.lit(True)) | sure(F.size(v.col) == 0)
        return sure(F.exists(v.col, each))
    if is_mixed(v.type):
        own = at_path(Val(mixed.member(v.col, name, False), v.type), more, s, env, True)
        if name.isdigit():
            return own
        each = lambda x: at_path(Val(mixed.member(x, name, False), v.type), more, s, env)
        inside = mixed.elements(v.col)
        spread = F.coalesce(F.forall(inside, lambda x: sure(each(x))), F.lit(True)) if negative else sure(F.exists(inside, lambda x: (mixed.rank_of(x) == 20) & each(x)))
        return F.when(mixed.rank_of(v.col) == 25, spread).otherwise(own)
    inner = step(v, [name], False)
    if inner.missing:
        if not isinstance(v.type, T.StructType | T.MapType):
            return F.lit(negative or (isinstance(s, dict) and s.get("$exists", True) is False))
        return F.when(v.col.isNull(), F.lit(negative or (isinstance(s, dict) and s.get("$exists", True) is False))).otherwise(tested(Val(None), s, env))
    found = at_path(inner, more, s, env, True)
    if _never_null(s):
        return found
    # A null parent offers no candidate.
    return F.when(v.col.isNull(), F.lit(bool(negative) or (isinstance(s, dict) and s.get("$exists", True) is False))).otherwise(found)


def _never_null(s) -> bool:
    """Whether s can't hold for a null, so that a null parent needs no test of its own."""
    if isinstance(s, dict):
        return bool(s) and all(k in ("$eq", "$gt", "$gte", "$lt", "$lte") and x is not None and not isinstance(x, dict | list | tuple) or k == "$in" and None not in x for k, x in s.items())
    return s is not None and not isinstance(s, list | tuple)


def tested(v: Val, s, env: Env) -> Column:
    if isinstance(s, re.Pattern):
        return _search(v, s.pattern, "".join(c for c, f in (("i", re.I), ("m", re.M), ("s", re.S), ("x", re.X)) if s.flags & f))
    if isinstance(s, dict) and s and all(k.startswith("$") for k in s):
        out = F.lit(True)
        for name, arg in s.items():
            if name != "$options":
                out = out & operator(name, v, arg, s, env)
        return out
    return equal(v, s)


def _any(v: Val, p) -> Column:
    """p on the value, or on some element of an array."""
    if is_mixed(v.type):
        return sure(p(v)) | sure(F.exists(mixed.elements(v.col), lambda x: p(Val(x, v.type))))
    if isinstance(v.type, T.ArrayType):
        return sure(F.exists(v.col, lambda x: p(Val(x, v.type.elementType))))
    return p(v)


def equal(v: Val, value) -> Column:
    if v.missing:
        return F.lit(value is None)
    if is_mixed(v.type):
        want = mixed.key(mixed.literal(value), True)
        return _any(v, lambda x: mixed.key(x.col, True) == want)
    lit = literal(value)
    if isinstance(v.type, T.ArrayType):
        if isinstance(value, list | tuple):
            if not value:
                return sure(F.size(v.col) == 0)
            whole = sure(v.col.eqNullSafe(lit.col.cast(v.type))) if rank(v.type.elementType) == rank(lit.type.elementType) else F.lit(False)
            return whole | (sure(F.exists(v.col, lambda x: same(Val(x, v.type.elementType), lit))) if isinstance(v.type.elementType, T.ArrayType) else F.lit(False))
        inside = sure(F.exists(v.col, lambda x: same(Val(x, v.type.elementType), lit)))
        return inside | v.col.isNull() if value is None else inside
    return same(v, lit)


def _search(v: Val, pattern: str, options: str) -> Column:
    if v.missing:
        return F.lit(False)
    if is_mixed(v.type):
        return _any(v, lambda x: mixed.text(x.col).rlike(flags(options) + pattern))
    return _any(v, lambda x: x.col.rlike(flags(options) + pattern) if rank(x.type) == 15 else F.lit(False))


def _compared(name: str, v: Val, value) -> Column:
    if v.missing:
        return F.lit(False)
    if is_mixed(v.type):
        want = mixed.literal(value)
        at = mixed.key(want)
        test = {"$gt": lambda k: k > at, "$gte": lambda k: k >= at, "$lt": lambda k: k < at, "$lte": lambda k: k <= at}[name]
        # A missing field is in no order, and only values of one rank are.
        return _any(v, lambda x: x.col.isNotNull() & (mixed.rank_of(x.col) == mixed.rank_of(want)) & test(mixed.key(x.col)))
    lit = literal(value)

    def one(x: Val) -> Column:
        if value is None:
            return x.col.isNull() if name in ("$gte", "$lte") else F.lit(False)
        if rank(x.type) != rank(lit.type):
            return F.lit(False)
        return {"$gt": x.col > lit.col, "$gte": x.col >= lit.col, "$lt": x.col < lit.col, "$lte": x.col <= lit.col}[name]

    return one(v) if isinstance(value, list | tuple) else _any(v, one)


def _among(v: Val, values) -> Column:
    if not isinstance(values, list | tuple):
        raise OperationFailure("$in needs a list")
    plain = [x for x in values if not isinstance(x, re.Pattern | list | tuple | dict) and x is not None]
    if not v.missing and not isinstance(v.type, T.ArrayType | T.VariantType) and len({rank(literal(x).type) for x in plain} | {rank(v.type)}) == 1:
        parts = [v.col.isin(plain)] if plain else []
        values = [x for x in values if isinstance(x, re.Pattern | list | tuple | dict) or x is None]
    else:
        parts = []
    parts += [tested(v, x, None) if isinstance(x, re.Pattern) else equal(v, x) for x in values]
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def operator(name: str, v: Val, arg, spec: dict, env: Env) -> Column:
    if name in UNSUPPORTED:
        raise NotImplementedError(f"the filter operator {name} is not supported")
    if name == "$eq":
        return equal(v, arg)
    if name == "$ne":
        return ~sure(equal(v, arg))
    if name in ("$gt", "$gte", "$lt", "$lte"):
        return _compared(name, v, arg)
    if name in ("$in", "$nin"):
        return _among(v, arg) if name == "$in" else ~sure(_among(v, arg))
    if name == "$exists" and not v.missing and is_mixed(v.type):
        return v.col.isNotNull() if arg else v.col.isNull()
    if name == "$exists":
        return F.lit(v.missing != bool(arg))
    if name == "$not":
        if not isinstance(arg, dict | re.Pattern):
            raise OperationFailure("$not needs a regex or a document")
        return ~sure(tested(v, arg, env))
    if name == "$regex":
        pattern, options = (arg.pattern, "i" if arg.flags & re.I else "") if isinstance(arg, re.Pattern) else (arg, "")
        return _search(v, pattern, options + spec.get("$options", ""))
    if name == "$size":
        if v.missing:
            return F.lit(False)
        if is_mixed(v.type):
            return sure(F.size(mixed.elements(v.col)) == arg)
        if isinstance(v.type, T.ArrayType | T.MapType):
            return sure(F.size(v.col) == arg)
        if isinstance(v.type, T.StructType):
            return v.col.isNotNull() & F.lit(len(v.type) == arg)
        return truth(v) & F.lit(arg == 1)
    if name == "$all":
        if not isinstance(arg, list | tuple):
            raise OperationFailure("$all needs a list")
        out = F.lit(bool(arg))
        for x in arg:
            out = out & (operator("$elemMatch", v, x["$elemMatch"], {}, env) if isinstance(x, dict) and "$elemMatch" in x else equal(v, x))
        return out
    if name == "$elemMatch":
        if not isinstance(arg, dict):
            raise OperationFailure("$elemMatch needs an Object")
        if not v.missing and is_mixed(v.type):
            return sure(F.exists(mixed.elements(v.col), lambda x: element(Val(x, v.type), arg, env)))
        return F.lit(False) if v.missing or not isinstance(v.type, T.ArrayType) else sure(F.exists(v.col, lambda x: element(Val(x, v.type.elementType), arg, env)))
    if name == "$type":
        kinds = arg if isinstance(arg, list | tuple) else [arg]
        out = F.lit(False)
        for k in kinds:
            if k == "null" and not v.missing and is_mixed(v.type):
                out = out | _any(v, lambda x: F.is_variant_null(x.col))
                continue
            if k == "objectId":  # ids are made as texts of 24 hexadecimal digits
                out = out | (F.lit(False) if v.missing else _search(v, "^[0-9a-f]{24}$", ""))
                continue
            if k in ("undefined", "null", "regex", "dbPointer", "javascript", "symbol", "javascriptWithScope", "timestamp", "minKey", "maxKey"):
                raise NotImplementedError(f"the type {k} is not supported")
            if k not in _TYPES:
                raise OperationFailure(f"{k} is not a valid $type")
            if not v.missing and is_mixed(v.type):
                out = out | _any(v, lambda x, k=k: _is_kind(x.col, k))
            elif not v.missing:
                own = v.col.isNotNull() if isinstance(v.type, _TYPES[k]) else F.lit(False)
                if isinstance(v.type, T.ArrayType) and isinstance(v.type.elementType, _TYPES[k]):
                    own = own | sure(F.exists(v.col, lambda x: x.isNotNull()))
                out = out | own
        return out
    raise OperationFailure(f"unknown operator: {name}")


def _is_kind(x: Column, k: str) -> Column:
    name = mixed.kind(x)
    if k in ("int", "long"):
        small = F.coalesce(F.try_variant_get(x, "$", "int").isNotNull(), F.lit(False))
        return name.isin("BIGINT", "INT", "SMALLINT", "TINYINT") & (small if k == "int" else ~small)
    return name.isin(*mixed.TYPES[k])


def element(v: Val, spec: dict, env: Env) -> Column:
    """An element of an array as a document, or as a value if the specification is of operators."""
    if spec and all(k.startswith("$") and k not in ("$and", "$or", "$nor") for k in spec):
        return tested(v, spec, env)
    out = F.lit(True)
    for key, s in spec.items():
        if key in ("$and", "$or", "$nor"):
            parts = [element(v, x, env) for x in s]
            one = parts[0]
            for p in parts[1:]:
                one = one & p if key == "$and" else one | p
            out = out & (~sure(one) if key == "$nor" else one)
        elif isinstance(v.type, T.StructType | T.MapType | T.VariantType):
            out = out & at_path(v, key.split("."), s, env)
        else:
            out = F.lit(False)
    return out
