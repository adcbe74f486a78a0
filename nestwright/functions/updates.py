"""Update documents compiled to one new column per changed field, guarded by the rows that match.

Numbers widen and objects gain members; where values of types meet that don't fit into one, the field becomes a VARIANT,
of which $set, $unset, $rename and $setOnInsert write any value and the other operators raise. An absent field is null here, so $inc, $min, $max and $push start from nothing at a null.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestwright.errors import OperationFailure, WriteError
from nestwright.functions import mixed
from nestwright.functions.expressions import Env, Val, is_number, literal, rank, same
from nestwright.functions.mixed import is_mixed
from nestwright.functions.predicates import at_path, element, sure, tested

Change = Callable[[Val | None], Val]
OPERATORS = set("$set $unset $inc $max $min $pop $rename $setOnInsert $currentDate $addToSet $push $pull $pullAll".split())
_NUMBERS = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]


def merged(a: T.DataType | None, b: T.DataType | None) -> T.DataType:
    """The type that holds values of both."""
    if a is None or isinstance(a, T.NullType):
        return b or T.NullType()
    if b is None or isinstance(b, T.NullType) or a == b:
        return a
    if type(a) in _NUMBERS and type(b) in _NUMBERS:
        integral = {type(a), type(b)} & {T.LongType} and {type(a), type(b)} & {T.FloatType}
        return T.DoubleType() if integral else max(a, b, key=lambda t: _NUMBERS.index(type(t)))
    if is_number(a) and is_number(b):
        return T.DecimalType(38, 18)
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        theirs = {f.name: f.dataType for f in b}
        mine = [T.StructField(f.name, merged(f.dataType, theirs.pop(f.name, None))) for f in a]
        return T.StructType([*mine, *(T.StructField(n, t) for n, t in theirs.items())])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(merged(a.elementType, b.elementType))
    return T.VariantType()


def retyped(v: Val, t: T.DataType) -> Column:
    """v's column with type t, which merged() gave. A null of a fixed type is a missing field in a VARIANT."""
    if v.type == t:
        return v.col
    if is_mixed(t) and not v.missing and not isinstance(v.type, T.NullType):
        return F.when(v.col.isNotNull(), mixed.as_variant(v.col, v.type))
    if v.missing or isinstance(v.type, T.NullType):
        return F.lit(None).cast(t)
    if isinstance(t, T.StructType):
        own = set(v.type.fieldNames())
        parts = [(retyped(Val(v.col.getField(f.name), v.type[f.name].dataType), f.dataType) if f.name in own else F.lit(None).cast(f.dataType)).alias(f.name) for f in t]
        return F.when(v.col.isNotNull(), F.struct(*parts))
    if isinstance(t, T.ArrayType):
        return F.transform(v.col, lambda x: retyped(Val(x, v.type.elementType), t.elementType))
    return v.col.cast(t)


def inferred(value) -> T.DataType:
    """The type of a Python value."""
    if isinstance(value, dict):
        return T.StructType([T.StructField(k, inferred(x)) for k, x in value.items()])
    if isinstance(value, list | tuple):
        t: T.DataType = T.NullType()
        for x in value:
            t = merged(t, inferred(x))
        return T.ArrayType(t)
    for kinds, t in ((bool, T.BooleanType()), (int, T.LongType()), (float, T.DoubleType()), (str, T.StringType()), (bytes, T.BinaryType()), (datetime.datetime, T.TimestampNTZType()), (datetime.date, T.DateType()), (type(None), T.NullType())):
        if isinstance(value, kinds):
            return t
    raise WriteError(f"values of {type(value).__name__} can't be stored")


def fitted(value, t: T.DataType | None) -> Val:
    """A Python value as a column of a type that t can be merged with."""
    whole = merged(t, inferred(value))
    if is_mixed(whole):
        return Val(mixed.literal(value), whole)

    def build(x, kind: T.DataType) -> Column:
        if is_mixed(kind):
            return mixed.literal(x)
        if x is None:
            return F.lit(None).cast(kind)
        if isinstance(kind, T.StructType):
            return F.struct(*(build(x.get(f.name), f.dataType).alias(f.name) for f in kind))
        if isinstance(kind, T.ArrayType):
            return F.array(*(build(y, kind.elementType) for y in x)).cast(kind)
        return literal(x).col.cast(kind)

    return Val(build(value, whole), whole)


def _when(match: Column, new: Val, old: Val | None) -> Val:
    old = old or Val(F.lit(None), T.NullType())
    t = merged(old.type, new.type)
    return Val(F.when(match, retyped(new, t)).otherwise(retyped(old, t)), t)


def changed(old: Val | None, rest: list[str], change: Change, match: Column, at: Column | None) -> Val:
    """old with the value at a path below it changed where match holds; `at` is the place that `$` stands for."""
    if not rest:
        return _when(match, change(old), old)
    name, more = rest[0], rest[1:]
    if old is None or isinstance(old.type, T.NullType | T.StructType):
        parts, own = [], isinstance(old.type, T.StructType) if old else False
        for f in old.type if own else ():
            v = Val(old.col.getField(f.name), f.dataType)
            parts.append((f.name, changed(v, more, change, match, at) if f.name == name else v))
        if name not in [n for n, _ in parts]:
            parts.append((name, changed(None, more, change, match, at)))
        col = F.struct(*(v.col.alias(n) for n, v in parts))
        there = match | old.col.isNotNull() if own else match
        return Val(F.when(there, col), T.StructType([T.StructField(n, v.type) for n, v in parts]))
    if not isinstance(old.type, T.ArrayType):
        raise WriteError(f"can't create the field {name} in a value of type {old.type.simpleString()}")
    inner, yes = old.type.elementType, F.lit(True)
    kind = T.ArrayType(changed(Val(F.lit(None).cast(inner), inner), more, change, yes, None).type)
    if name == "$":
        if at is None:
            raise WriteError("the positional operator needs a condition on its array")
        place = F.when(match & (at < 0), F.raise_error(F.lit("The positional operator did not find the match needed from the query.")).cast("int")).otherwise(at)
    elif re.fullmatch(r"\d+", name):
        place = F.lit(int(name))
    else:
        raise WriteError(f"can't create the field {name} in an array")
    wide = Val(retyped(old, kind), kind)
    if name == "$":  # the place is searched for once a row, not once an element
        one = changed(Val(F.get(wide.col, place), kind.elementType), more, change, yes, None).col
        new = F.concat(F.slice(wide.col, F.lit(1), place), F.array(one), F.slice(wide.col, place + 2, F.size(wide.col)))
    else:
        new = F.transform(wide.col, lambda x, i: F.when(i == place, changed(Val(x, kind.elementType), more, change, yes, None).col).otherwise(x))
        gap = F.array_repeat(F.lit(None).cast(kind.elementType), F.greatest(place - F.size(wide.col), F.lit(0)))
        end = F.array(changed(Val(F.lit(None).cast(kind.elementType), kind.elementType), more, change, yes, None).col)
        new = F.when(F.size(wide.col) > place, new).otherwise(F.concat(wide.col, gap, end))
    return Val(F.when(match & wide.col.isNotNull(), new).otherwise(wide.col), kind)


def place_of(path: str, filter_: dict, state: dict[str, Val], env: Env) -> Column | None:
    """Where in the array before `.$` the first element stands that the filter's conditions on the array accept; -1 if none does."""
    head, *rest = path.split(".")
    if "$" not in rest:
        return None
    before = rest[: rest.index("$")]
    v = state.get(head)
    for name in before:
        v = Val(v.col.getField(name), v.type[name].dataType) if v and isinstance(v.type, T.StructType) and name in v.type.fieldNames() else None
    if v is None or not isinstance(v.type, T.ArrayType):
        raise WriteError("the positional operator needs an array")
    array, tests = ".".join([head, *before]), []
    for key, s in filter_.items():
        if key == array:
            tests.append(lambda x, s=s: element(x, s["$elemMatch"], env) if isinstance(s, dict) and "$elemMatch" in s else tested(x, s, env))
        elif key.startswith(array + "."):
            tests.append(lambda x, s=s, below=key[len(array) + 1 :].split("."): at_path(x, below, s, env))
    if not tests:
        return None

    def hit(x: Column) -> Column:
        out = F.lit(True)
        for t in tests:
            out = out & t(Val(x, v.type.elementType))
        return sure(out)

    return F.coalesce(F.array_position(F.transform(v.col, hit), True), F.lit(0)).cast("int") - 1


def _equal(x: Val, value) -> Column:
    """x equals a Python value; objects by their members."""
    if isinstance(x.type, T.StructType) and isinstance(value, dict):
        out = x.col.isNotNull()
        for f in x.type:
            out = out & _equal(Val(x.col.getField(f.name), f.dataType), value.get(f.name))
        return out & F.lit(set(value) <= set(x.type.fieldNames()))
    if value is None:
        return x.col.isNull()
    lit = literal(value)
    return sure(same(x, lit)) if rank(x.type) == rank(lit.type) or rank(x.type) == 5 else F.lit(False)


def _array(name: str, old: Val | None, items: list) -> Val:
    """The old array, ready for items; nothing counts as an empty one."""
    if old is not None and not isinstance(old.type, T.ArrayType | T.NullType):
        raise WriteError(f"{name} needs an array")
    t = merged(old.type if old else None, inferred(list(items)))
    return Val(F.coalesce(retyped(old, t), F.array().cast(t)) if old else F.array().cast(t), t)


def _plus(arg) -> Change:
    if isinstance(arg, bool) or not isinstance(arg, int | float):
        raise WriteError("$inc needs a number")

    def change(old: Val | None) -> Val:
        if old is None or isinstance(old.type, T.NullType):
            return literal(arg)
        if not is_number(old.type):
            raise WriteError("$inc needs a field of numbers")
        t = merged(old.type, inferred(arg) if isinstance(old.type, T.LongType | T.DoubleType) or isinstance(arg, float) else literal(arg).type)
        return Val(F.coalesce(old.col.cast(t), F.lit(0).cast(t)) + F.lit(arg).cast(t), t)

    return change


def _bound(name: str, arg) -> Change:
    def change(old: Val | None) -> Val:
        new = fitted(arg, old.type if old else None)
        return new if old is None else Val((F.greatest if name == "$max" else F.least)(retyped(old, new.type), new.col), new.type)

    return change


def _pop(arg) -> Change:
    if arg not in (1, -1) or isinstance(arg, bool):
        raise WriteError("$pop needs 1 or -1")

    def change(old: Val | None) -> Val:
        if old is None or isinstance(old.type, T.NullType):
            return Val(F.lit(None), T.NullType())
        if not isinstance(old.type, T.ArrayType):
            raise WriteError("$pop needs an array")
        n = F.greatest(F.size(old.col) - 1, F.lit(0))
        return Val(F.slice(old.col, F.lit(1 if arg == 1 else 2), n), old.type)

    return change


def _ordering(spec):
    """A comparator of array elements: null lowest, then by the named members."""
    keys = list(spec.items()) if isinstance(spec, dict) else [(None, spec)]
    if any(way not in (1, -1) for _, way in keys):
        raise WriteError("the $sort of a $push needs 1 or -1")

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for name, way in reversed(keys):
            x, y = (a, b) if name is None else (a.getField(name), b.getField(name))
            out = F.when(x.isNull() & y.isNull(), out).when(x.isNull(), F.lit(-way)).when(y.isNull(), F.lit(way)).when(x < y, F.lit(-way)).when(x > y, F.lit(way)).otherwise(out)
        return out

    return compare


def _push(arg) -> Change:
    more = arg if isinstance(arg, dict) and "$each" in arg else {"$each": [arg]}
    if set(more) - {"$each", "$position", "$sort", "$slice"}:
        raise WriteError("unknown modifier of $push")

    def change(old: Val | None) -> Val:
        base = _array("$push", old, more["$each"])
        items = fitted(list(more["$each"]), base.type).col
        at = more.get("$position")
        if at is None:
            out = F.concat(base.col, items)
        else:
            cut = F.least(F.lit(at), F.size(base.col)) if at >= 0 else F.greatest(F.size(base.col) + at, F.lit(0))
            out = F.concat(F.slice(base.col, F.lit(1), cut), items, F.slice(base.col, cut + 1, F.size(base.col)))
        if "$sort" in more:
            out = F.array_sort(out, _ordering(more["$sort"]))
        if "$slice" in more:
            n = more["$slice"]
            out = F.slice(out, 1, n) if n >= 0 else F.slice(out, F.greatest(F.size(out) + n, F.lit(0)) + 1, F.lit(-n))
        return Val(out, base.type)

    return change


def _add_to_set(arg) -> Change:
    items = list(arg["$each"]) if isinstance(arg, dict) and "$each" in arg else [arg]

    def change(old: Val | None) -> Val:
        base = _array("$addToSet", old, items)

        def one(v) -> Column:
            there = F.exists(base.col, lambda x: _equal(Val(x, base.type.elementType), v))
            return F.when(there, F.array().cast(base.type)).otherwise(fitted([v], base.type).col)

        new = [one(v) for v in items]
        return Val(F.concat(base.col, *new), base.type)

    return change


def _pull(arg, env: Env, listed: bool) -> Change:
    def gone(x: Val) -> Column:
        if listed:
            out = F.lit(False)
            for v in arg:
                out = out | _equal(x, v)
            return out
        return sure(element(x, arg, env)) if isinstance(arg, dict) else _equal(x, arg)

    def change(old: Val | None) -> Val:
        if old is None or isinstance(old.type, T.NullType):
            return Val(F.lit(None), T.NullType())
        if not isinstance(old.type, T.ArrayType):
            raise WriteError("$pull needs an array")
        return Val(F.filter(old.col, lambda x: ~gone(Val(x, old.type.elementType))), old.type)

    return change


def _now(arg, now: datetime.datetime) -> Change:
    if arg is not True and arg not in ({"$type": "date"}, {"$type": "timestamp"}):
        raise WriteError("$currentDate needs true or a type")
    return lambda old: literal(now)


def _nothing(old: Val | None) -> Val:
    return Val(F.lit(None), T.NullType())


def exists(state: dict[str, Val], path: str) -> bool:
    """Whether the schema has the path."""
    head, *rest = path.split(".")
    v = state[head].type if head in state else None
    for name in rest:
        if isinstance(v, T.StructType) and name in v.fieldNames():
            v = v[name].dataType
        elif isinstance(v, T.ArrayType) and (name == "$" or name.isdigit()):
            v = v.elementType
        else:
            return False
    return v is not None


def compile_update(update: dict, state: dict[str, Val], match: Column, env: Env, filter_: dict, inserting: bool, now: datetime.datetime) -> dict[str, Val]:
    """All fields after the update; operators apply in the order written."""
    state = dict(state)
    for name, spec in update.items():
        if name not in OPERATORS:
            raise ValueError(f"{name} is not an update operator")
        for path, arg in spec.items():
            head, *rest = path.split(".")
            if name == "$setOnInsert" and not inserting:
                continue
            if head == "_id" and not inserting and name != "$setOnInsert":
                raise WriteError("the field _id can't be changed")
            if name in ("$unset", "$pull", "$pullAll", "$pop") and not exists(state, path):
                continue
            if name == "$rename":
                if rest or "." in arg:
                    raise NotImplementedError("$rename of dotted fields is not supported")
                if head in state:
                    was = state[head]
                    state[arg] = _when(match, was, state.get(arg))
                    state[head] = _when(match, _nothing(None), was)
                continue
            if name == "$pullAll" and not isinstance(arg, list | tuple):
                raise OperationFailure("$pullAll needs a list")
            makers = {
                "$set": lambda: lambda old: fitted(arg, old.type if old else None), "$setOnInsert": lambda: lambda old: fitted(arg, old.type if old else None),
                "$unset": lambda: _nothing, "$inc": lambda: _plus(arg), "$max": lambda: _bound("$max", arg), "$min": lambda: _bound("$min", arg), "$pop": lambda: _pop(arg),
                "$currentDate": lambda: _now(arg, now), "$addToSet": lambda: _add_to_set(arg), "$push": lambda: _push(arg), "$pull": lambda: _pull(arg, env, False), "$pullAll": lambda: _pull(arg, env, True),
            }
            if head in state and is_mixed(state[head].type) and (rest or name not in ("$set", "$unset", "$setOnInsert")):
                raise NotImplementedError(f"{name} of {path}, a field of mixed types, is not supported")
            state[head] = changed(state.get(head), rest, makers[name](), match, place_of(path, filter_, state, env))
    return state
