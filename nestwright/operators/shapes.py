"""Projections, added fields and other row-wise shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestwright.errors import OperationFailure
from nestwright.functions import mixed
from nestwright.functions.expressions import Env, Val, compile_expression, step
from nestwright.functions.mixed import is_mixed

#: Prefix of columns that carry order and aren't part of the document.
HIDDEN = "__"


def shown(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith(HIDDEN)]


def hidden(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns if c.startswith(HIDDEN)]


def env_of(df: DataFrame) -> Env:
    return Env(df.select(*(F.col(f"`{c}`") for c in shown(df))))


def tree(paths: list[str]) -> dict:
    out: dict = {}
    for p in sorted(paths, key=lambda p: p.count(".")):
        at, parts = out, p.split(".")
        for x in parts[:-1]:
            at = at.setdefault(x, {})
            if at is None:
                raise OperationFailure(f"Path collision at {p}")
        if parts[-1] in at:
            raise OperationFailure(f"Path collision at {p}")
        at[parts[-1]] = None
    return out


def included(v: Val, sub: dict | None) -> Column | None:
    """The value with only the named members; None if nothing of it is kept."""
    if sub is None:
        return v.col
    if isinstance(v.type, T.ArrayType):
        if included(Val(F.lit(None), v.type.elementType), sub) is None:
            return None
        return F.transform(v.col, lambda x: included(Val(x, v.type.elementType), sub))
    if isinstance(v.type, T.VariantType):
        raise NotImplementedError("members of a field of mixed types can't be kept alone; name each with an expression")
    if not isinstance(v.type, T.StructType):
        return None
    kept = [(f.name, included(Val(v.col.getField(f.name), f.dataType), sub[f.name])) for f in v.type if f.name in sub]
    kept = [(n, c) for n, c in kept if c is not None]
    return F.when(v.col.isNotNull(), F.struct(*(c.alias(n) for n, c in kept))) if kept else None


def excluded(v: Val, sub: dict | None) -> Column | None:
    if sub is None:
        return None
    if isinstance(v.type, T.ArrayType):
        return F.transform(v.col, lambda x: excluded(Val(x, v.type.elementType), sub))
    if isinstance(v.type, T.VariantType):
        raise NotImplementedError("members of a field of mixed types can't be left out alone")
    if not isinstance(v.type, T.StructType):
        return v.col
    kept = [(f.name, excluded(Val(v.col.getField(f.name), f.dataType), sub[f.name]) if f.name in sub else v.col.getField(f.name)) for f in v.type]
    kept = [(n, c) for n, c in kept if c is not None]
    return F.when(v.col.isNotNull(), F.struct(*(c.alias(n) for n, c in kept))) if kept else v.col


def project(df: DataFrame, spec: dict) -> DataFrame:
    """$project: 0, 1 and booleans exclude and include; anything else is an expression."""
    if not spec:
        raise OperationFailure("Invalid $project :: the specification must have at least one field")
    env, types = env_of(df), {f.name: f.dataType for f in df.schema}
    plain = {k: bool(v) for k, v in spec.items() if isinstance(v, bool) or (isinstance(v, int | float) and v in (0, 1))}
    first = next((k for k in spec if not (k == "_id" and plain.get(k) is False)), None)
    exclusion = first is not None and plain.get(first) is False or first is None
    for k in spec:
        if k != "_id" and (plain.get(k) is False) != exclusion:
            raise OperationFailure("Bad projection specification: inclusion and exclusion can't be mixed")
    if exclusion:
        cut = tree([k for k in spec if plain.get(k) is False])
        out = [(c, excluded(Val(F.col(f"`{c}`"), types[c]), cut[c]) if c in cut else F.col(f"`{c}`")) for c in shown(df)]
        return df.select(*(c.alias(n) for n, c in out if c is not None), *hidden(df))
    kept = tree([k for k in plain if plain[k]])
    if "_id" in types and "_id" not in spec:
        kept = {"_id": None} | kept
    out = [(c, included(Val(F.col(f"`{c}`"), types[c]), kept[c])) for c in shown(df) if c in kept]
    made = [(k, compile_expression(v, env)) for k, v in spec.items() if k not in plain]
    return df.select(*(c.alias(n) for n, c in out if c is not None), *(v.col.alias(k) for k, v in made if not v.missing), *hidden(df))


def put(v: Val | None, path: list[str], value: Column) -> Column:
    """v with the value at a path below it; objects on the way are made."""
    if not path:
        return value
    name, rest = path[0], path[1:]
    if v is not None and isinstance(v.type, T.StructType):
        own = Val(v.col.getField(name), v.type[name].dataType) if name in v.type.fieldNames() else None
        fields = [(f.name, v.col.getField(f.name)) for f in v.type if f.name != name] if own is None else [(f.name, put(own, rest, value) if f.name == name else v.col.getField(f.name)) for f in v.type]
        if own is None:
            fields.append((name, put(None, rest, value)))
        return F.struct(*(c.alias(n) for n, c in fields))
    if v is not None and isinstance(v.type, T.ArrayType):
        return F.transform(v.col, lambda x: put(Val(x, v.type.elementType), path, value))
    return F.struct(put(None, rest, value).alias(name))


def add_fields(df: DataFrame, spec: dict) -> DataFrame:
    """$addFields and $set: every expression sees the input; dotted names reach into objects."""
    if not spec:
        raise OperationFailure("Invalid $addFields :: the specification must have at least one field")
    env, types = env_of(df), {f.name: f.dataType for f in df.schema}
    new: dict[str, Val] = {}
    for key, e in spec.items():
        v = compile_expression(e, env)
        if v.missing:
            continue
        head, *rest = key.split(".")
        base = new.get(head) or (Val(F.col(f"`{head}`"), types[head]) if head in types else None)
        col = put(base, rest, v.col)
        new[head] = Val(col, env.typed(col) if rest else v.type)
    kept = [new.pop(c).col.alias(c) if c in new else F.col(f"`{c}`") for c in shown(df)]
    return df.select(*kept, *(v.col.alias(k) for k, v in new.items()), *hidden(df))


def unwind(df: DataFrame, spec) -> DataFrame:
    """$unwind: a row per element; other values stay one row, and absent ones go or are preserved."""
    spec = {"path": spec} if isinstance(spec, str) else spec
    path, keep, index = spec["path"], spec.get("preserveNullAndEmptyArrays", False), spec.get("includeArrayIndex")
    if not isinstance(path, str) or not path.startswith("$"):
        raise ValueError("$unwind needs a path that starts with $")
    head, *rest = path[1:].split(".")
    types = {f.name: f.dataType for f in df.schema}
    v = step(Val(F.col(f"`{head}`"), types[head]), rest, False) if head in types else Val(None)
    if v.missing:
        return df.withColumn(index, F.lit(None).cast("bigint")) if keep and index else df if keep else df.limit(0)
    array = F.lit(True)
    if is_mixed(v.type):  # what is no array is one row without an index
        if rest:
            raise NotImplementedError("a member of a field of mixed types can't be unwound")
        array = mixed.rank_of(v.col) == 25
        listed = F.coalesce(mixed.elements(v.col), F.when(v.col.isNotNull() if keep else ~mixed.is_null(v.col), F.array(v.col)))
        v = Val(listed, T.ArrayType(T.VariantType()))
    if not isinstance(v.type, T.ArrayType):
        out = df if keep else df.where(v.col.isNotNull())
        return out.withColumn(index, F.lit(None).cast("bigint")) if index else out
    rows = df.withColumn("__at", F.when(F.size(v.col) > 0, v.col)).withColumn("__array", array)
    rows = rows.select("*", (F.posexplode_outer if keep else F.posexplode)("__at").alias("__pos", "__item")).drop("__at")
    rows = rows.withColumn(head, put(Val(F.col(f"`{head}`"), types[head]), rest, F.col("__item")))
    if index:
        rows = rows.withColumn(index, F.when(F.col("__array"), F.col("__pos").cast("bigint")))
    return rows.drop("__pos", "__item", "__array")
