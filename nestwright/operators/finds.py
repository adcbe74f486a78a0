"""Reads of a collection: projection of a find, order, distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestwright.errors import OperationFailure
from nestwright.functions import mixed
from nestwright.functions.expressions import Env, Val, sliced, step
from nestwright.functions.mixed import is_mixed
from nestwright.functions.predicates import element
from nestwright.operators.shapes import env_of, excluded, hidden, included, shown, tree


def _matching(t: T.DataType, spec, env: Env):
    return lambda x: element(Val(x, t), spec, env)


def find_project(df: DataFrame, spec: dict | list | None) -> DataFrame:
    """A find's projection: all fields in or all out, but for _id; $slice and $elemMatch rework arrays."""
    if not spec:
        return df
    spec = dict.fromkeys(spec, 1) if isinstance(spec, list | tuple) else spec
    types, env = {f.name: f.dataType for f in df.schema}, env_of(df)
    plain = {k: bool(v) for k, v in spec.items() if not isinstance(v, dict)}
    rest = {k: v for k, v in plain.items() if k != "_id"}
    if len(set(rest.values())) > 1:
        raise ValueError("You cannot currently mix including and excluding fields.")
    if any("$" in k.split(".") for k in spec):
        raise NotImplementedError("positional projection is not supported")
    inclusion = any(rest.values()) or (not rest and plain.get("_id", False)) or (not rest and any("$elemMatch" in v for v in spec.values() if isinstance(v, dict)))
    special = {}
    for path, how in spec.items():
        if not isinstance(how, dict):
            continue
        if not set(how) <= {"$slice", "$elemMatch"}:
            raise ValueError(f"Unsupported projection option: {next(k for k in how if k not in ('$slice', '$elemMatch'))}")
        if len(how) != 1:
            raise NotImplementedError("a projection takes one of $slice and $elemMatch")
        ((name, arg),) = how.items()
        head, *below = path.split(".")
        t = types.get(head)
        if t is None or below:  # a dotted name is no field of the document itself, so there is nothing to rework
            continue
        if name == "$elemMatch":
            if isinstance(t, T.ArrayType):
                hits = F.filter(F.col(f"`{head}`"), _matching(t.elementType, arg, env))
                special[head] = F.when(F.size(hits) > 0, F.slice(hits, 1, 1))
            else:
                special[head] = None
        else:
            if isinstance(arg, bool) or not (isinstance(arg, int) or (isinstance(arg, list | tuple) and len(arg) == 2 and arg[1] > 0)):
                raise OperationFailure("$slice needs a number or two")
            if not isinstance(t, T.ArrayType):
                raise OperationFailure("$slice needs an array")
            special[head] = sliced(F.col(f"`{head}`"), *([arg] if isinstance(arg, int) else arg))
    if inclusion:
        kept = tree([k for k, v in plain.items() if v])
        if "_id" in types and plain.get("_id", True):
            kept = {"_id": None} | kept
        out = [(c, special[c] if c in special else included(Val(F.col(f"`{c}`"), types[c]), kept[c])) for c in shown(df) if c in kept or c in special]
    else:
        cut = tree([k for k, v in plain.items() if not v])
        out = [(c, special[c] if c in special else excluded(Val(F.col(f"`{c}`"), types[c]), cut[c]) if c in cut else F.col(f"`{c}`")) for c in shown(df)]
    return df.select(*(c.alias(n) for n, c in out if c is not None), *hidden(df))


def distinct(df: DataFrame, key: str) -> DataFrame:
    """The values of a path, arrays opened one level; null is a value, a missing path has none. Column `value`."""
    head, *rest = key.split(".")
    types = {f.name: f.dataType for f in df.schema}
    v = step(Val(F.col(f"`{head}`"), types[head]), rest, True) if head in types else Val(None)
    if v.missing:
        return df.select(F.lit(None).cast("string").alias("value")).limit(0)
    out = v.col
    if is_mixed(v.type):
        out = F.explode(F.coalesce(mixed.elements(v.col), F.when(v.col.isNotNull(), F.array(v.col)), F.array().cast("array<variant>")))
        return df.select(out.alias("value")).groupBy(mixed.key(F.col("value")).alias("k")).agg(F.first("value").alias("value")).select("value")
    if isinstance(v.type, T.ArrayType):
        inner = v.type.elementType
        out = F.explode(F.when(v.col.isNull(), F.array(F.lit(None).cast(inner))).otherwise(v.col))
    return df.select(out.alias("value")).distinct()
