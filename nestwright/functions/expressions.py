"""Aggregation expressions compiled to Columns.

Every declared field is present and SQL NULL is the document null; a path that the schema doesn't have is missing, known
while compiling. A missing operand makes arithmetic null, comparisons missing and conditions false, and a missing
result omits the field. Types are static, so comparisons across types are settled by rank while compiling. A field of
mixed types is a VARIANT: there missing is SQL NULL, and ranks are compared as the query runs.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestwright.errors import OperationFailure
from nestwright.functions import mixed
from nestwright.functions.mixed import is_mixed


@dataclass(frozen=True)
class Val:
    """A compiled value: its column and type, or nothing if it is missing."""

    col: Column | None
    type: T.DataType | None = None

    @property
    def missing(self) -> bool:
        return self.col is None


MISSING = Val(None)


def literal(v) -> Val:
    if isinstance(v, list | tuple):
        inner = [literal(x) for x in v]
        if not inner:
            return Val(F.array().cast("array<string>"), T.ArrayType(T.StringType()))
        if len({rank(x.type) for x in inner} - {5, None}) > 1:
            return Val(F.array(*map(mixed.literal, v)), T.ArrayType(T.VariantType()))
        return Val(F.array(*(x.col for x in inner)), T.ArrayType(inner[0].type))
    if isinstance(v, dict):
        inner = {k: literal(x) for k, x in v.items()}
        return Val(F.struct(*(x.col.alias(k) for k, x in inner.items())), T.StructType([T.StructField(k, x.type) for k, x in inner.items()]))
    if isinstance(v, datetime.datetime):
        v = v.replace(tzinfo=None, microsecond=v.microsecond // 1000 * 1000)
        return Val(F.lit(v.isoformat(" ")).cast("timestamp_ntz"), T.TimestampNTZType())
    kinds = {bool: T.BooleanType(), int: T.LongType() if isinstance(v, int) and not -(2**31) <= v < 2**31 else T.IntegerType(), float: T.DoubleType(), str: T.StringType(), bytes: T.BinaryType(), type(None): T.NullType()}
    if type(v) not in kinds:
        return Val(F.lit(v), None)
    return Val(F.lit(v), kinds[type(v)])


#: Rank of types where values of different types are compared.
def rank(t: T.DataType | None) -> int | None:
    if t is None:
        return None
    for n, kinds in ((5, T.NullType), (10, T.NumericType), (15, (T.StringType, T.VarcharType, T.CharType)), (20, (T.StructType, T.MapType)), (25, T.ArrayType), (30, T.BinaryType), (40, T.BooleanType), (45, (T.TimestampNTZType, T.TimestampType, T.DateType))):
        if isinstance(t, kinds):
            return n
    return None


def is_number(t: T.DataType | None) -> bool:
    return isinstance(t, T.NumericType)


@dataclass
class Env:
    """What names mean: the input's fields and the variables around."""

    frame: DataFrame
    vars: dict[str, Val] = field(default_factory=dict)

    def root(self) -> Val:
        return Val(F.struct(*(F.col(f"`{c}`") for c in self.frame.columns)), self.frame.schema)

    def bind(self, **more: Val) -> Env:
        return Env(self.frame, self.vars | more)

    def typed(self, col: Column) -> T.DataType:
        return self.frame.select(col.alias("x")).schema[0].dataType

    def path(self, path: str) -> Val:
        """A `$path` of an expression: through arrays of objects one level deep, by place with a number."""
        head, *rest = path.split(".")
        names = {f.name: f.dataType for f in self.frame.schema}
        if head not in names:
            return MISSING
        return step(Val(F.col(f"`{head}`"), names[head]), rest, True)


def step(v: Val, rest: list[str], spread: bool) -> Val:
    for i, name in enumerate(rest):
        if isinstance(v.type, T.StructType):
            if name not in v.type.fieldNames():
                return MISSING
            v = Val(v.col.getField(name), v.type[name].dataType)
        elif isinstance(v.type, T.MapType):
            v = Val(F.try_element_at(v.col, F.lit(name)), v.type.valueType)
        elif is_mixed(v.type):
            v = Val(mixed.member(v.col, name, spread), v.type)
        elif isinstance(v.type, T.ArrayType) and re.fullmatch(r"-?\d+", name):
            n = int(name)
            v = Val(F.get(v.col, F.lit(n)) if n >= 0 else F.try_element_at(v.col, F.lit(n)), v.type.elementType)
        elif isinstance(v.type, T.ArrayType) and spread:
            inner = step(Val(F.lit(None), v.type.elementType), rest[i:], False)
            if inner.missing:
                return MISSING
            return _spread(v, rest[i:], inner.type)
        else:
            return MISSING
    return v


def _spread(v: Val, rest: list[str], kind: T.DataType) -> Val:
    return Val(F.transform(v.col, lambda x: step(Val(x, v.type.elementType), rest, False).col), T.ArrayType(kind))


def truth(v: Val) -> Column:
    """False for false, null, 0 and what is missing; everything else is true."""
    if v.missing or isinstance(v.type, T.NullType):
        return F.lit(False)
    if isinstance(v.type, T.BooleanType):
        return F.coalesce(v.col, F.lit(False))
    if is_mixed(v.type):
        false = F.coalesce(mixed.number(v.col) == 0, F.lit(False)) | F.coalesce((mixed.kind(v.col) == "BOOLEAN") & ~F.try_variant_get(v.col, "$", "boolean"), F.lit(False))
        return ~mixed.is_null(v.col) & ~false
    return F.coalesce(v.col != 0, F.lit(False)) if is_number(v.type) else v.col.isNotNull()


def comparable(a: Val, b: Val) -> tuple[Column, Column] | None:
    """Both columns if Spark can compare them; None if only their ranks can."""
    ra, rb = rank(a.type), rank(b.type)
    if ra is None or rb is None or ra == rb or 5 in (ra, rb):
        return a.col, b.col
    if {ra, rb} == {10, 40}:  # true and 1 are equal
        return (a.col.cast("int") if ra == 40 else a.col), (b.col.cast("int") if rb == 40 else b.col)
    return None


def key_of(v: Val, numbers: bool = False) -> Column:
    """What a value of any type is compared by."""
    return mixed.key(mixed.as_variant(v.col, v.type), numbers)


def same(a: Val, b: Val) -> Column:
    if is_mixed(a.type) or is_mixed(b.type):
        return key_of(a, True) == key_of(b, True)
    both = comparable(a, b)
    return F.lit(False) & a.col.isNull() if both is None else both[0].eqNullSafe(both[1])


def ordered(op: str, a: Val, b: Val) -> Column:
    """Comparison in the order of all values: null first, then by rank, then by value."""
    if is_mixed(a.type) or is_mixed(b.type):
        x, y = key_of(a), key_of(b)
        return {"$gt": x > y, "$gte": x >= y, "$lt": x < y, "$lte": x <= y}[op]
    ra, rb = rank(a.type), rank(b.type)
    if ra is not None and rb is not None and ra != rb and 5 not in (ra, rb):
        less = F.when(a.col.isNull() & b.col.isNull(), F.lit(0)).when(a.col.isNull(), F.lit(-1)).when(b.col.isNull(), F.lit(1)).otherwise(F.lit(-1 if ra < rb else 1))
    else:
        x, y = a.col, b.col
        if 5 in (ra, rb):
            less = F.when(x.isNull() & y.isNull(), 0).when(x.isNull(), -1).otherwise(1)
        else:
            return {"$gt": F.coalesce(x > y, x.isNotNull() & y.isNull()), "$gte": F.coalesce(x >= y, y.isNull()), "$lt": F.coalesce(x < y, x.isNull() & y.isNotNull()), "$lte": F.coalesce(x <= y, x.isNull())}[op]
    return {"$gt": less > 0, "$gte": less >= 0, "$lt": less < 0, "$lte": less <= 0}[op]


#: Named by the language, not supported.
UNSUPPORTED = set(
    "$cmp $indexOfBytes $indexOfCP $strLenBytes $strLenCP $substrBytes $substrCP $trim $ltrim $rtrim $dateFromString $isoDayOfWeek $isoWeek $isoWeekYear "
    "$dateToParts $indexOfArray $range $reduce $reverseArray $zip $setIntersection $setDifference $setIsSubset $anyElementTrue $allElementsTrue $convert $meta $stdDevPop $stdDevSamp".split()
)
_OPS: dict[str, Callable] = {}


def op(*names: str):
    def add(f):
        _OPS.update(dict.fromkeys(names, f))
        return f

    return add


def compile_expression(spec, env: Env) -> Val:
    if isinstance(spec, str) and spec.startswith("$$"):
        head, *rest = spec[2:].split(".")
        if head in ("ROOT", "CURRENT"):
            return env.path(".".join(rest)) if rest else env.root()
        if head not in env.vars:
            raise OperationFailure(f"undefined variable {head}")
        return step(env.vars[head], rest, True)
    if isinstance(spec, str) and spec.startswith("$"):
        return env.path(spec[1:])
    if isinstance(spec, dict) and any(k.startswith("$") for k in spec):
        if len(spec) != 1:
            raise OperationFailure("an expression has exactly one operator")
        ((name, arg),) = spec.items()
        if name in UNSUPPORTED or (name == "$mergeObjects"):
            raise NotImplementedError(f"the operator {name} is not supported")
        if name not in _OPS:
            raise OperationFailure(f"Unrecognized expression '{name}'")
        return _OPS[name](name, arg, env)
    if isinstance(spec, dict):
        inner = {k: v for k, v in ((k, compile_expression(x, env)) for k, x in spec.items()) if not v.missing}
        return Val(F.struct(*(v.col.alias(k) for k, v in inner.items())), T.StructType([T.StructField(k, v.type or T.NullType()) for k, v in inner.items()])) if inner else MISSING
    return literal(spec)  # a list is taken as it is


def _many(arg, env: Env, n: int | None = None, name: str = "") -> list[Val]:
    args = arg if isinstance(arg, list | tuple) else [arg]
    if n is not None and len(args) != n:
        raise OperationFailure(f"Expression {name} takes exactly {n} arguments. {len(args)} were passed in.")
    return [compile_expression(a, env) for a in args]


def _null(t: T.DataType) -> Val:
    return Val(F.lit(None).cast(t), t)


def as_number(name: str, v: Val) -> Val:
    """A value of mixed type as a double: null if it is null or missing, an error if it is no number."""
    if v.missing or not is_mixed(v.type):
        return v
    wrong = F.raise_error(F.concat(F.lit(f"Parameter to {name} must evaluate to a number, got "), mixed.kind(v.col))).cast("double")
    return Val(F.when(mixed.is_null(v.col), F.lit(None)).when(mixed.rank_of(v.col) == 10, mixed.number(v.col)).otherwise(wrong), T.DoubleType())


def _numbers(name: str, vals: list[Val]) -> None:
    for v in vals:
        if not v.missing and v.type is not None and not is_number(v.type) and not isinstance(v.type, T.NullType):
            raise OperationFailure(f"Parameter to {name} must evaluate to a number, got '{v.type.simpleString()}'")


@op("$literal")
def _literal(name, arg, env):
    return literal(arg)


@op("$let")
def _let(name, arg, env):
    if not isinstance(arg, dict) or set(arg) != {"vars", "in"}:
        raise OperationFailure("$let needs 'vars' and 'in'")
    return compile_expression(arg["in"], env.bind(**{k: compile_expression(v, env) for k, v in arg["vars"].items()}))


@op("$abs", "$ceil", "$exp", "$floor", "$ln", "$log10", "$sqrt", "$trunc")
def _one_number(name, arg, env):
    v = as_number(name, _many(arg, env, 1, name)[0])
    if v.missing:
        return _null(T.DoubleType())
    _numbers(name, [v])
    whole = {"$ceil": lambda x: F.ceil(x).cast("bigint"), "$floor": lambda x: F.floor(x).cast("bigint"), "$trunc": lambda x: x.cast("bigint")}
    if name in whole:
        return Val(whole[name](v.col), T.LongType())
    if name == "$abs":
        return Val(F.abs(v.col), v.type)
    return Val({"$exp": F.exp, "$ln": F.ln, "$log10": F.log10, "$sqrt": F.sqrt}[name](v.col), T.DoubleType())


@op("$add", "$multiply")
def _sums(name, arg, env):
    vals = [as_number(name, v) for v in _many(arg, env)]
    if any(v.missing or isinstance(v.type, T.NullType) for v in vals):
        return _null(T.DoubleType())
    _numbers(name, vals)
    cols = list(map(_long, vals))
    out = cols[0]
    for c in cols[1:]:
        out = out + c if name == "$add" else out * c
    return Val(out, _sum_type(vals))


def _long(v: Val) -> Column:
    """Whole numbers as 64 bits, so that sums of 32 bits don't overflow."""
    return v.col.cast("bigint") if isinstance(v.type, T.IntegralType) else v.col


def _sum_type(vals: list[Val]) -> T.DataType:
    kind = _wider(vals)
    return T.LongType() if isinstance(kind, T.IntegralType) else kind


def _wider(vals: list[Val]) -> T.DataType:
    if any(v.type is None or isinstance(v.type, T.DoubleType | T.FloatType) for v in vals):
        return T.DoubleType()
    decimal = [v.type for v in vals if isinstance(v.type, T.DecimalType)]
    return T.DecimalType(38, 10) if decimal else T.LongType() if any(isinstance(v.type, T.LongType) for v in vals) else T.IntegerType()


@op("$subtract", "$divide", "$mod", "$pow", "$log")
def _two_numbers(name, arg, env):
    a, b = _many(arg, env, 2, name)
    if a.missing or b.missing:
        return _null(T.DoubleType())
    if name == "$subtract" and rank(a.type) == 45:
        if rank(b.type) == 45:
            return Val(F.timestamp_diff("MILLISECOND", b.col, a.col), T.LongType())
        return Val(F.timestamp_add("MILLISECOND", -b.col.cast("bigint"), a.col), a.type)
    a, b = as_number(name, a), as_number(name, b)
    _numbers(name, [a, b])
    if name == "$subtract":
        return Val(_long(a) - _long(b), _sum_type([a, b]))
    x, y = a.col.cast("double"), b.col.cast("double")
    return Val({"$divide": lambda: x / y, "$mod": lambda: x % y, "$pow": lambda: F.pow(x, y), "$log": lambda: F.log(x) / F.log(y)}[name](), T.DoubleType())


def _extreme(keyed: Column, name: str) -> Column:
    """The value with the least or largest key of an array of (key, value); nulls don't count."""
    some = F.filter(keyed, lambda x: x["k"]["rank"] > 5)
    less = (lambda a, b: a["k"] < b["k"]) if name == "$min" else (lambda a, b: a["k"] > b["k"])
    return F.aggregate(some, F.get(some, F.lit(0)), lambda a, x: F.when(less(x, a), x).otherwise(a))["v"]


@op("$sum", "$avg", "$min", "$max")
def _reduced(name, arg, env):
    if isinstance(arg, list | tuple):
        vals = [Val(mixed.number(v.col), T.DoubleType()) if is_mixed(v.type) and name in ("$sum", "$avg") else v for v in _many(arg, env) if not v.missing]
        if name in ("$min", "$max") and any(is_mixed(v.type) for v in vals):
            keyed = F.array(*(F.struct(key_of(v).alias("k"), mixed.as_variant(v.col, v.type).alias("v")) for v in vals))
            return Val(_extreme(keyed, name), T.VariantType())
        if name in ("$sum", "$avg"):
            vals = [Val(v.col.cast("int"), T.IntegerType()) if isinstance(v.type, T.BooleanType) else v for v in vals if is_number(v.type) or isinstance(v.type, T.BooleanType)]
        if not vals:
            return literal(0) if name == "$sum" else _null(T.DoubleType())
        if name in ("$min", "$max"):
            return Val((F.least if name == "$min" else F.greatest)(*(v.col for v in vals)) if len(vals) > 1 else vals[0].col, vals[0].type)
        total = sum((F.coalesce(_long(v), F.lit(0)) for v in vals[1:]), F.coalesce(_long(vals[0]), F.lit(0)))
        n = sum((v.col.isNotNull().cast("int") for v in vals[1:]), vals[0].col.isNotNull().cast("int"))
        return Val(total, _sum_type(vals)) if name == "$sum" else Val(F.when(n > 0, total / n), T.DoubleType())
    v = opened(compile_expression(arg, env))
    if not v.missing and isinstance(v.type, T.ArrayType) and is_mixed(v.type.elementType):
        if name in ("$min", "$max"):
            return Val(_extreme(F.transform(v.col, lambda x: F.struct(mixed.key(x).alias("k"), x.alias("v"))), name), T.VariantType())
        v = Val(F.transform(v.col, mixed.number), T.ArrayType(T.DoubleType()))
    if v.missing or not isinstance(v.type, T.ArrayType):
        if not v.missing and is_number(v.type):
            return v if name != "$sum" else Val(F.coalesce(v.col, F.lit(0)), v.type)
        return literal(0) if name == "$sum" else _null(T.DoubleType())
    if name in ("$min", "$max"):
        return Val((F.array_min if name == "$min" else F.array_max)(v.col), v.type.elementType)
    if not is_number(v.type.elementType):
        return literal(0) if name == "$sum" else _null(T.DoubleType())
    kept = F.filter(v.col, lambda x: x.isNotNull())
    kind = T.LongType() if isinstance(v.type.elementType, T.IntegralType) else T.DoubleType()
    total = F.aggregate(kept, F.lit(0).cast(kind), lambda a, x: a + x.cast(kind))
    return Val(F.coalesce(total, F.lit(0).cast(kind)), kind) if name == "$sum" else Val(F.when(F.size(kept) > 0, total / F.size(kept)), T.DoubleType())


@op("$first", "$last")
def _ends(name, arg, env):
    v = opened(compile_expression(arg, env))
    if v.missing:
        return MISSING
    if not isinstance(v.type, T.ArrayType):
        raise OperationFailure(f"{name} needs an array")
    return Val(F.try_element_at(v.col, F.lit(1 if name == "$first" else -1)), v.type.elementType)


@op("$arrayElemAt")
def _at(name, arg, env):
    v, i = _many(arg, env, 2, name)
    v = opened(v)
    if v.missing or i.missing:
        return MISSING
    if isinstance(arg[1], int):
        return Val(F.get(v.col, i.col) if arg[1] >= 0 else F.try_element_at(v.col, i.col), v.type.elementType)
    place = i.col.cast("int")
    return Val(F.when(place >= 0, F.get(v.col, place)).otherwise(F.try_element_at(v.col, F.least(place, F.lit(-1)))), v.type.elementType)


@op("$eq", "$ne", "$gt", "$gte", "$lt", "$lte")
def _compared(name, arg, env):
    a, b = _many(arg, env, 2, name)
    if a.missing or b.missing:
        return MISSING
    absent = [v.col.isNull() for v in (a, b) if is_mixed(v.type)]
    if absent:  # a missing operand makes the comparison missing
        test = same(a, b) if name == "$eq" else ~same(a, b) if name == "$ne" else ordered(name, a, b)
        return Val(F.when(~(absent[0] if len(absent) == 1 else absent[0] | absent[1]), test), T.BooleanType())
    return Val(same(a, b) if name == "$eq" else ~same(a, b) if name == "$ne" else ordered(name, a, b), T.BooleanType())


@op("$and", "$or", "$not")
def _boolean(name, arg, env):
    if name == "$not":
        if isinstance(arg, list | tuple):  # a list is taken as it is, and is true
            return literal(False)
        return Val(~truth(compile_expression(arg, env)), T.BooleanType())
    out = F.lit(name == "$and")
    for v in _many(arg, env):
        out = out & truth(v) if name == "$and" else out | truth(v)
    return Val(out, T.BooleanType())


@op("$cond")
def _cond(name, arg, env):
    if isinstance(arg, dict):
        if set(arg) != {"if", "then", "else"}:
            raise OperationFailure("$cond needs 'if', 'then' and 'else'")
        arg = [arg["if"], arg["then"], arg["else"]]
    test, yes, no = _many(arg, env, 3, name)
    return _branches([(truth(test), yes)], no)


def opened(v: Val) -> Val:
    """An array of mixed values for a value of mixed type; null if it is no array."""
    return Val(mixed.elements(v.col), T.ArrayType(T.VariantType())) if not v.missing and is_mixed(v.type) else v


def differ(vals: list[Val]) -> bool:
    """Whether values are of types that don't compare, so that only a variant holds them."""
    return any(is_mixed(v.type) for v in vals) or len({rank(v.type) for v in vals if not v.missing and not isinstance(v.type, T.NullType)} - {None}) > 1


def widened(v: Val) -> Val:
    return Val(F.lit(None).cast("variant") if v.missing else mixed.as_variant(v.col, v.type), T.VariantType())


def _branches(tests: list[tuple[Column, Val]], other: Val) -> Val:
    vals = [v for _, v in tests] + [other]
    if differ(vals):
        tests, other = [(t, widened(v)) for t, v in tests], widened(other)
        vals = [v for _, v in tests] + [other]
    kind = next((v.type for v in vals if not v.missing and not isinstance(v.type, T.NullType)), T.NullType())
    if is_number(kind):
        kind = _wider([v for v in vals if not v.missing and is_number(v.type)])
    out = None
    for t, v in tests:
        c = F.lit(None) if v.missing else v.col
        out = F.when(t, c) if out is None else out.when(t, c)
    return Val(out.otherwise(F.lit(None) if other.missing else other.col), kind)


@op("$ifNull")
def _if_null(name, arg, env):
    vals = [v for v in _many(arg, env) if not v.missing]
    if not vals:
        return MISSING
    if differ(vals):
        vals = [widened(v) for v in vals]
        null = F.parse_json(F.lit("null"))
        return Val(F.coalesce(*(F.when(~mixed.is_null(v.col), v.col) for v in vals), null), T.VariantType())
    kind = next((v.type for v in vals if not isinstance(v.type, T.NullType)), T.NullType())
    if is_number(kind):
        kind = _wider([v for v in vals if is_number(v.type)])
    return Val(F.coalesce(*(v.col for v in vals)), kind)


@op("$switch")
def _switch(name, arg, env):
    if not isinstance(arg, dict) or not arg.get("branches") or set(arg) - {"branches", "default"}:
        raise OperationFailure("$switch needs at least one branch")
    tests = []
    for b in arg["branches"]:
        if set(b) != {"case", "then"}:
            raise OperationFailure("$switch branches need 'case' and 'then'")
        tests.append((truth(compile_expression(b["case"], env)), compile_expression(b["then"], env)))
    other = compile_expression(arg["default"], env) if "default" in arg else Val(F.raise_error(F.lit("$switch could not find a matching branch, and no default was specified")), tests[0][1].type)
    return _branches(tests, other)


def _text(v: Val) -> Column:
    if isinstance(v.type, T.BooleanType):
        return F.initcap(v.col.cast("string"))
    return F.try_variant_get(v.col, "$", "string") if is_mixed(v.type) else v.col.cast("string")


@op("$toLower", "$toUpper")
def _case(name, arg, env):
    (v,) = _many(arg, env, 1, name)
    return MISSING if v.missing else Val(F.coalesce((F.lower if name == "$toLower" else F.upper)(_text(v)), F.lit("")), T.StringType())


@op("$concat")
def _concat(name, arg, env):
    vals = _many(arg, env)
    return _null(T.StringType()) if any(v.missing for v in vals) else Val(F.concat(*map(_text, vals)), T.StringType())


@op("$split")
def _split(name, arg, env):
    v, by = _many(arg, env, 2, name)
    if v.missing or by.missing:
        return _null(T.ArrayType(T.StringType()))
    if rank(v.type) not in (5, 15) or rank(by.type) not in (5, 15):
        raise OperationFailure("$split needs strings")
    return Val(F.split(v.col, F.concat(F.lit("\\Q"), by.col, F.lit("\\E")), F.lit(-1)), T.ArrayType(T.StringType()))


@op("$substr")
def _substr(name, arg, env):
    v, start, n = _many(arg, env, 3, name)
    if v.missing:
        return MISSING
    text = F.coalesce(_text(v), F.lit("None"))
    return Val(F.when(start.col < 0, "").otherwise(F.substring(text, start.col + 1, F.when(n.col < 0, F.lit(2**31 - 1)).otherwise(n.col))), T.StringType())


@op("$strcasecmp")
def _strcmp(name, arg, env):
    a, b = _many(arg, env, 2, name)
    if a.missing or b.missing:
        return MISSING
    x, y = _text(a), _text(b)
    return Val(F.when(x == y, 0).when(x < y, -1).otherwise(1), T.IntegerType())


def flags(options: str) -> str:
    kept = "".join(c for c in "imsx" if c in (options or ""))
    return f"(?{kept})" if kept else ""


@op("$regexMatch")
def _regex(name, arg, env):
    if not isinstance(arg, dict) or not {"input", "regex"} <= set(arg) or set(arg) - {"input", "regex", "options"}:
        raise OperationFailure("$regexMatch needs 'input' and 'regex'")
    v = compile_expression(arg["input"], env)
    if v.missing:
        return literal(False)
    pattern, options = arg["regex"], arg.get("options") or ""
    if isinstance(pattern, re.Pattern):
        options += "".join(c for c, f in (("i", re.I), ("m", re.M), ("s", re.S), ("x", re.X)) if pattern.flags & f)
        pattern = pattern.pattern
    if not isinstance(pattern, str) or set(options) - set("imsx"):
        raise OperationFailure("$regexMatch needs a pattern and the options i, m, s or x")
    if is_mixed(v.type):
        v = Val(mixed.text(v.col), T.StringType())
    if rank(v.type) != 15:
        raise OperationFailure("$regexMatch needs 'input' to be of type string")
    found = v.col.rlike(flags(options) + pattern)
    return Val(F.when(v.col.isNull(), F.raise_error(F.lit("$regexMatch needs 'input' to be of type string")).cast("boolean")).otherwise(found), T.BooleanType())


_DATE = {
    "$year": F.year, "$month": F.month, "$dayOfMonth": F.dayofmonth, "$hour": F.hour, "$minute": F.minute, "$second": F.second, "$dayOfYear": F.dayofyear, "$dayOfWeek": F.dayofweek,
    "$week": lambda d: F.floor((F.dayofyear(d) + 7 - F.dayofweek(d)) / 7).cast("int"), "$millisecond": lambda d: F.date_format(d, "SSS").cast("int"),
}


@op(*_DATE)
def _date_part(name, arg, env):
    zone = None
    if isinstance(arg, dict) and "date" in arg:
        zone, arg = arg.get("timezone"), arg["date"]
    (v,) = _many(arg, env, 1, name)
    if v.missing:
        return MISSING
    if rank(v.type) not in (5, 45):
        raise OperationFailure(f"{name} needs a date")
    col = v.col if zone is None else F.convert_timezone(F.lit("UTC"), F.lit(zone), v.col)
    return Val(_DATE[name](col), T.IntegerType())


#: strftime directives and the patterns of date_format.
_FORMATS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%f": "SSSSSS", "%%": "'%'"}


@op("$dateToString")
def _date_text(name, arg, env):
    if not isinstance(arg, dict) or not {"format", "date"} <= set(arg):
        raise OperationFailure("$dateToString needs 'format' and 'date'")
    if set(arg) - {"format", "date"} or "%L" in arg["format"]:
        raise NotImplementedError("$dateToString supports neither onNull, timezone nor %L")
    v = compile_expression(arg["date"], env)
    if v.missing:
        return MISSING
    parts = re.findall(r"%.|[^%]+", arg["format"])
    pattern = "".join(_FORMATS[p] if p in _FORMATS else "'" + p.replace("'", "''") + "'" for p in parts)
    return Val(F.date_format(v.col, pattern), T.StringType())


@op("$dateFromParts")
def _date_made(name, arg, env):
    if not isinstance(arg, dict) or "year" not in arg:
        raise OperationFailure("$dateFromParts requires 'year' to be present")
    if {"isoWeekYear", "isoWeek", "isoDayOfWeek", "timezone"} & set(arg):
        raise NotImplementedError("$dateFromParts supports neither iso weeks nor timezone")
    part = lambda k, d: compile_expression(arg.get(k, d), env).col
    seconds = (part("second", 0) + part("millisecond", 0) / 1e6).cast("decimal(16,6)")  # the parts language counts these as microseconds
    return Val(F.make_timestamp_ntz(part("year", 1970), part("month", 1), part("day", 1), part("hour", 0), part("minute", 0), seconds), T.TimestampNTZType())


@op("$concatArrays", "$setUnion")
def _arrays(name, arg, env):
    vals = _many(arg, env)
    if any(v.missing for v in vals):
        return MISSING if name == "$setUnion" else _null(T.ArrayType(T.StringType()))
    if any(rank(v.type) not in (5, 25) for v in vals):
        raise OperationFailure(f"{name} only supports arrays")
    kind = next((v.type for v in vals if isinstance(v.type, T.ArrayType)), T.ArrayType(T.StringType()))
    whole = F.concat(*(v.col.cast(kind) for v in vals))
    return Val(whole if name == "$concatArrays" else F.array_distinct(whole), kind)


@op("$map", "$filter")
def _mapped(name, arg, env):
    body = "in" if name == "$map" else "cond"
    if not isinstance(arg, dict) or not {"input", body} <= set(arg) or set(arg) - {"input", "as", body}:
        raise OperationFailure(f"{name} needs 'input' and '{body}'")
    v = opened(compile_expression(arg["input"], env))
    if v.missing:
        return _null(T.ArrayType(T.StringType())) if name == "$map" else MISSING
    if not isinstance(v.type, T.ArrayType):
        raise OperationFailure(f"input to {name} must be an array")
    var, of = arg.get("as", "this"), v.type.elementType
    inner = lambda x: compile_expression(arg[body], env.bind(**{var: Val(x, of)}))
    if name == "$filter":
        return Val(F.filter(v.col, lambda x: _python_truth(inner(x))), v.type)
    probe = inner(F.lit(None).cast(of))
    return Val(F.transform(v.col, lambda x: F.lit(None) if inner(x).missing else inner(x).col), T.ArrayType(probe.type or T.StringType()))


def _python_truth(v: Val) -> Column:
    """As truth(), but empty strings and arrays are false too."""
    if not v.missing and isinstance(v.type, T.StringType):
        return F.coalesce(v.col != "", F.lit(False))
    return F.coalesce(F.size(v.col) > 0, F.lit(False)) if not v.missing and isinstance(v.type, T.ArrayType) else truth(v)


@op("$size")
def _size(name, arg, env):
    v = opened(_many(arg, env, 1, name)[0])
    if v.missing or not isinstance(v.type, T.ArrayType):
        raise OperationFailure("The argument to $size must be an array")
    return Val(F.when(v.col.isNull(), F.raise_error(F.lit("The argument to $size must be an array")).cast("int")).otherwise(F.size(v.col)), T.IntegerType())


@op("$slice")
def _slice(name, arg, env):
    if not isinstance(arg, list | tuple) or len(arg) not in (2, 3) or not all(isinstance(x, int) for x in arg[1:]):
        raise OperationFailure("$slice takes an array and one or two whole numbers")
    v = opened(compile_expression(arg[0], env))
    if v.missing:
        return MISSING
    return Val(sliced(v.col, *arg[1:]), v.type)


def sliced(col: Column, a: int, b: int | None = None) -> Column:
    if b is not None:
        if b <= 0:
            raise OperationFailure("the last number of $slice must be positive")
        start = F.lit(a) if a >= 0 else F.greatest(F.size(col) + a, F.lit(0))
        return F.slice(col, start + 1, F.lit(b))
    return F.slice(col, F.lit(1), F.lit(a)) if a >= 0 else F.slice(col, F.greatest(F.size(col) + a, F.lit(0)) + 1, F.lit(-a))


@op("$in")
def _in(name, arg, env):
    a, v = _many(arg, env, 2, name)
    v = opened(v)
    if a.missing or v.missing:
        return MISSING
    if not isinstance(v.type, T.ArrayType):
        raise OperationFailure("$in requires an array as a second argument")
    return Val(F.coalesce(F.exists(v.col, lambda x: same(Val(x, v.type.elementType), a)), F.lit(False)), T.BooleanType())


@op("$setEquals")
def _set_equals(name, arg, env):
    vals = _many(arg, env)
    if any(v.missing for v in vals):
        return MISSING
    out = F.lit(True)
    for v in vals[1:]:
        out = out & (F.size(F.array_except(vals[0].col, v.col)) == 0) & (F.size(F.array_except(v.col, vals[0].col)) == 0)
    return Val(out, T.BooleanType())


@op("$arrayToObject", "$objectToArray")
def _objects(name, arg, env):
    (v,) = _many([arg] if not (isinstance(arg, list) and len(arg) == 1) else arg, env, 1, name)
    if v.missing:
        return _null(T.MapType(T.StringType(), T.StringType()))
    if name == "$arrayToObject":
        t = v.type.elementType
        pair = (lambda x: F.struct(x["k"], x["v"])) if isinstance(t, T.StructType) else (lambda x: F.struct(x[0], x[1]))
        kind = t["v"].dataType if isinstance(t, T.StructType) else t.elementType
        return Val(F.map_from_entries(F.transform(v.col, pair)), T.MapType(T.StringType(), kind))
    if isinstance(v.type, T.StructType):
        members = [Val(v.col.getField(f.name), f.dataType) for f in v.type]
        if differ(members):
            entry = F.array(*(F.struct(F.lit(f.name).alias("k"), mixed.as_variant(m.col, m.type).alias("v")) for f, m in zip(v.type, members, strict=True)))
            return Val(F.when(v.col.isNotNull(), entry), T.ArrayType(T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.VariantType())])))
        entry = F.array(*(F.struct(F.lit(f.name).alias("k"), v.col.getField(f.name).alias("v")) for f in v.type))
        kind = v.type[0].dataType
        col = F.when(v.col.isNotNull(), entry)
    else:
        kind = v.type.valueType
        col = F.transform(F.map_entries(v.col), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    return Val(col, T.ArrayType(T.StructType([T.StructField("k", T.StringType()), T.StructField("v", kind)])))


@op("$toString", "$toInt", "$toLong", "$toDecimal")
def _cast(name, arg, env):
    (v,) = _many(arg, env, 1, name)
    kind = {"$toString": T.StringType(), "$toInt": T.IntegerType(), "$toLong": T.LongType(), "$toDecimal": T.DecimalType(38, 14)}[name]
    if v.missing:
        return _null(kind)
    if rank(v.type) == 45 and name == "$toString":
        ms = F.date_format(v.col, "SSS")
        text = F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        return Val(F.when(ms == "000", F.date_format(v.col, "yyyy-MM-dd'T'HH:mm'Z'")).otherwise(text), kind)
    if rank(v.type) == 45:
        return Val(F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), v.col.cast("timestamp_ntz")).cast(kind), kind)
    col = v.col.cast("string") if name == "$toString" else v.col.cast("int").cast(kind) if isinstance(v.type, T.BooleanType) else v.col.cast(kind)
    return Val(F.coalesce(col, F.lit("None")) if name == "$toString" else col, kind)


@op("$isNumber", "$isArray")
def _is(name, arg, env):
    if name == "$isArray" and isinstance(arg, list | tuple) and not (len(arg) == 1 and isinstance(arg[0], str)):
        return literal(True)
    (v,) = _many(arg, env, 1, name)
    if not v.missing and is_mixed(v.type):
        return Val(mixed.rank_of(v.col) == (10 if name == "$isNumber" else 25), T.BooleanType())
    fits = not v.missing and (is_number(v.type) if name == "$isNumber" else isinstance(v.type, T.ArrayType))
    return Val(v.col.isNotNull(), T.BooleanType()) if fits else literal(False)
