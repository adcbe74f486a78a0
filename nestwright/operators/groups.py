"""$group and $bucket: hash aggregation with partial sums. Only $push holds a whole group, which is its result; the other
ordered accumulators keep one row, or the distinct values, of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestwright.errors import OperationFailure
from nestwright.functions import mixed
from nestwright.functions.expressions import Env, Val, compile_expression, is_number, key_of, rank
from nestwright.functions.mixed import is_mixed
from nestwright.operators.shapes import env_of

#: Accumulators whose result depends on the order of rows.
ORDERED = {"$first", "$last", "$push", "$addToSet", "$mergeObjects"}
#: Made of $addToSet whose result is only asked for its size.
COUNT_SET = "$addToSet size"
Order = list[tuple[str, bool]]


def in_order(value: Column, order: Order, loose: bool = False) -> Column:
    """The group's values as an array in the order of the rows; `loose` if the values themselves have no order."""
    rows = F.collect_list(F.struct(*(F.col(f"`{c}`").alias(f"k{i}") for i, (c, _) in enumerate(order)), value.alias("x")))
    if all(up for _, up in order) and not loose:
        return F.transform(F.array_sort(rows), lambda r: r["x"])

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for i, (_, up) in reversed(list(enumerate(order))):
            x, y = a[f"k{i}"], b[f"k{i}"]
            less = F.when(x.isNull() & y.isNull(), out).when(x.isNull(), F.lit(-1 if up else 1)).when(y.isNull(), F.lit(1 if up else -1))
            out = less.when(x < y, F.lit(-1 if up else 1)).when(x > y, F.lit(1 if up else -1)).otherwise(out)
        return out

    return F.transform(F.array_sort(rows, compare), lambda r: r["x"])


def _flipped(c: Column, t: T.DataType) -> Column | None:
    """A key that rises where c falls, with null last as it was first; None if there is none for the type."""
    if isinstance(t, T.IntegralType):
        less = F.bitwise_not(c)
    elif is_number(t):
        less = -c
    elif isinstance(t, T.BooleanType):
        less = ~c
    elif isinstance(t, T.DateType | T.TimestampType | T.TimestampNTZType):
        less = F.timestamp_diff("MICROSECOND", c.cast("timestamp_ntz"), F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"))
    else:
        return None
    return F.struct(c.isNull().alias("no"), less.alias("x"))


def place(order: Order, types: dict[str, T.DataType]) -> tuple[Column, bool] | None:
    """One comparable column for the order of rows, and whether it rises; None if its keys can't be brought together."""
    stiff = {up for c, up in order if _flipped(F.col(f"`{c}`"), types[c]) is None}
    if len(stiff) > 1:
        return None
    rises = stiff.pop() if stiff else order[0][1]
    return F.struct(*((F.col(f"`{c}`") if up == rises else _flipped(F.col(f"`{c}`"), types[c])).alias(f"p{i}") for i, (c, up) in enumerate(order))), rises


def _truthy(v: Val) -> Column:
    """The value, null where it is falsy."""
    if is_mixed(v.type):
        falsy = F.coalesce(mixed.number(v.col) == 0, F.lit(False)) | F.coalesce(mixed.text(v.col) == "", F.lit(False)) | F.coalesce((mixed.kind(v.col) == "BOOLEAN") & ~F.try_variant_get(v.col, "$", "boolean"), F.lit(False))
        return F.when(~falsy & ~mixed.is_null(v.col), v.col)
    falsy = v.col == 0 if is_number(v.type) else v.col == "" if rank(v.type) == 15 else ~v.col if rank(v.type) == 40 else F.lit(False)
    return F.when(~F.coalesce(falsy, F.lit(False)), v.col)


def accumulator(name: str, arg, env: Env, order: Order, types: dict[str, T.DataType]) -> Column:
    if name in ("$stdDevPop", "$stdDevSamp"):
        raise NotImplementedError(f"the accumulator {name} is not supported")
    v = compile_expression(arg, env)
    if not v.missing and is_mixed(v.type):
        if name in ("$sum", "$avg"):
            v = Val(mixed.number(v.col), T.DoubleType())  # what is no number doesn't count
        elif name in ("$min", "$max"):
            return (F.min_by if name == "$min" else F.max_by)(v.col, F.when(~mixed.is_null(v.col), mixed.key(v.col)))
        elif name == COUNT_SET:
            kept = _truthy(v)
            return (F.count_distinct(F.when(kept.isNotNull(), mixed.key(kept))) + F.coalesce(F.max(kept.isNull().cast("int")), F.lit(0))).cast("int")
    if name in ("$sum", "$avg"):
        if not v.missing and isinstance(v.type, T.BooleanType):
            v = Val(v.col.cast("int"), T.IntegerType()) if name == "$sum" else v
        if v.missing or not is_number(v.type):
            return F.max(F.lit(0)) if name == "$sum" else F.max(F.lit(None).cast("double"))
        return F.coalesce(F.sum(v.col), F.lit(0).cast("bigint" if isinstance(v.type, T.IntegralType) else v.type)) if name == "$sum" else F.avg(v.col)
    if name in ("$min", "$max"):
        return (F.min if name == "$min" else F.max)(F.lit(None) if v.missing else v.col)
    at = place(order, types) if name in ("$first", "$last", "$mergeObjects") else None
    if name in ("$first", "$last"):
        if v.missing:
            return F.max(F.lit(None))
        if at is None:
            return F.try_element_at(in_order(v.col, order), F.lit(1 if name == "$first" else -1))
        return (F.min_by if (name == "$first") == at[1] else F.max_by)(v.col, at[0])
    if name == "$push":
        return F.max(F.array().cast("array<string>")) if v.missing else in_order(v.col, order, is_mixed(v.type))
    if name == COUNT_SET:
        return F.lit(0).cast("int") if v.missing else (F.count_distinct(_truthy(v)) + F.coalesce(F.max(_truthy(v).isNull().cast("int")), F.lit(0))).cast("int")
    if name == "$mergeObjects":
        if v.missing or not isinstance(v.type, T.StructType):
            return F.max(F.lit(None))
        if at is None:
            latest = F.try_element_at(F.filter(in_order(v.col, order), lambda x: x.isNotNull()), F.lit(-1))
        else:
            latest = (F.max_by if at[1] else F.min_by)(v.col, F.when(v.col.isNotNull(), at[0]))
        return F.struct(*(latest.getField(f.name).alias(f.name) for f in v.type))
    raise NotImplementedError(f"the accumulator {name} is not supported")


def _sets(df: DataFrame, key: Column, spec: dict, env: Env, order: Order) -> dict[str, DataFrame]:
    """For each $addToSet a table of __id and the distinct values in order of first appearance: grouped by value first,
    so that a large group is never in one array."""
    types, out = {f.name: f.dataType for f in df.schema}, {}
    for name, acc in spec.items():
        if not isinstance(acc, dict) or set(acc) != {"$addToSet"}:
            continue
        v = compile_expression(acc["$addToSet"], env)
        if v.missing:
            continue
        at = place(order, types)
        where, rises = at if at is not None else (F.struct(F.col(f"`{order[-1][0]}`")), True)
        kept = _truthy(v)
        by = [key.alias("__id"), mixed.key(kept).alias("__k")] if is_mixed(v.type) else [key.alias("__id"), kept.alias("__v")]
        each = df.groupBy(*by).agg((F.min if rises else F.max)(where).alias("__p"), *([F.first(kept).alias("__v")] if is_mixed(v.type) else []))
        rows = F.collect_list(F.struct("__p", "__v"))
        listed = F.array_sort(rows, lambda a, b: F.when(a["__p"] < b["__p"], -1).when(a["__p"] > b["__p"], 1).otherwise(0))
        listed = listed if rises else F.reverse(listed)
        out[name] = each.groupBy("__id").agg(F.transform(listed, lambda x: x["__v"]).alias(name))
    return out


def _outputs(df: DataFrame, spec: dict, env: Env, order: Order, sets: dict[str, DataFrame]) -> list[Column]:
    out, types = [], {f.name: f.dataType for f in df.schema}
    for name, acc in spec.items():
        if not isinstance(acc, dict) or len(acc) != 1:
            raise OperationFailure(f"The field '{name}' must specify one accumulator")
        ((kind, arg),) = acc.items()
        if name in sets:
            continue
        if kind == "$addToSet":
            out.append(F.max(F.array().cast("array<string>")).alias(name))
        else:
            out.append(accumulator(kind, arg, env, order, types).alias(name))
    return out


def _aggregated(df: DataFrame, key: Column | None, spec: dict, order: Order, value: Column | None = None) -> DataFrame:
    """A row per key (`__id`) with its accumulators; without a key one row, also of nothing. `value`, if given, is the
    value that the key stands for (`__value`)."""
    env, whole = env_of(df), key is None
    key = F.lit(1) if whole else key
    sets = _sets(df, key, spec, env, order)
    outs = _outputs(df, spec, env, order, sets) + ([] if value is None else [F.first(value).alias("__value")])
    if whole:
        made = df.agg(*(outs or [F.count("*").alias("__n")])).withColumn("__id", key)
    else:
        made = df.groupBy(key.alias("__id")).agg(*outs) if outs else df.select(key.alias("__id")).distinct()
    for name, listed in sets.items():
        none = F.array().cast(listed.schema[name].dataType)
        made = made.join(listed.withColumnRenamed("__id", "__other"), F.col("__id").eqNullSafe(F.col("__other")), "left").drop("__other").withColumn(name, F.coalesce(F.col(f"`{name}`"), none))
    return made


def group(df: DataFrame, spec: dict, order: Order, by_key: bool = True) -> DataFrame:
    """$group: falsy ids make one group, also of nothing; a missing key is null. Groups come out in key order, unless
    nothing later asks for it."""
    if "_id" not in spec:
        raise KeyError("_id")
    rest = {k: v for k, v in spec.items() if k != "_id"}
    if not spec["_id"]:
        made = _aggregated(df, None, rest, order)
        return made.select(*(F.col(f"`{k}`") for k in rest), F.lit(None).cast("string").alias("_id"))
    v = compile_expression(spec["_id"], env_of(df))
    loose = not v.missing and has_mixed(v.type)
    made = _aggregated(df, F.lit(None).cast("string") if v.missing else comparable_key(v) if loose else v.col, rest, order, v.col if loose else None)
    made = made.orderBy(F.col("__id").asc_nulls_first()) if by_key else made
    key = F.col("__value" if loose else "__id")
    key = F.coalesce(key, F.parse_json(F.lit("null"))) if loose and is_mixed(v.type) else key  # a missing key is null
    return made.select(*(F.col(f"`{k}`") for k in rest), key.alias("_id"))


def has_mixed(t: T.DataType | None) -> bool:
    return is_mixed(t) or isinstance(t, T.StructType) and any(has_mixed(f.dataType) for f in t)


def comparable_key(v: Val) -> Column:
    """A key that Spark can group by, for a value with variants in it."""
    if is_mixed(v.type):
        return key_of(v)
    if isinstance(v.type, T.StructType):
        return F.struct(*(comparable_key(Val(v.col.getField(f.name), f.dataType)).alias(f.name) for f in v.type))
    return v.col


def bucket(df: DataFrame, spec: dict, order: Order) -> DataFrame:
    """$bucket: [low, high) by boundaries, everything else in the default or an error."""
    if set(spec) - {"groupBy", "boundaries", "default", "output"} or not {"groupBy", "boundaries"} <= set(spec):
        raise OperationFailure("$bucket requires 'groupBy' and 'boundaries' to be specified")
    bounds = spec["boundaries"]
    if not isinstance(bounds, list) or len(bounds) < 2 or any(type(a) is not type(b) or not a < b for a, b in zip(bounds, bounds[1:], strict=False)):
        raise OperationFailure("The 'boundaries' of $bucket must be two or more values of one type, rising")
    default = spec.get("default")
    if "default" in spec and type(default) is type(bounds[0]) and bounds[0] <= default < bounds[-1]:
        raise OperationFailure("The $bucket 'default' must be less than the lowest boundary or at least the highest")
    env = env_of(df)
    v = compile_expression(spec["groupBy"], env)
    value = F.lit(None) if v.missing else v.col
    where = F.lit(None).cast("int")
    for i in range(len(bounds) - 2, -1, -1):
        where = F.when((value >= F.lit(bounds[i])) & (value < F.lit(bounds[i + 1])), i).otherwise(where)
    if "default" not in spec:
        where = F.coalesce(where, F.raise_error(F.lit("$bucket could not find a matching branch, and no default was specified")).cast("int"))
    out = spec.get("output", {"count": {"$sum": 1}})
    made = _aggregated(df, where, out, order).withColumnRenamed("__id", "__b")
    first = type(default) is type(bounds[0]) and default < bounds[0]
    text = "default" in spec and type(default) is not type(bounds[0])
    name = lambda x: F.lit(str(x) if text else x)  # noqa: E731  ids of two types are shown as text
    ids = F.when(F.col("__b").isNull(), name(default))
    for i, b in enumerate(bounds[:-1]):
        ids = ids.when(F.col("__b") == i, name(b))
    sort = F.col("__b").asc_nulls_first() if first else F.col("__b").asc_nulls_last()
    return made.withColumn("_id", ids).orderBy(sort).select("_id", *(F.col(f"`{c}`") for c in out))
