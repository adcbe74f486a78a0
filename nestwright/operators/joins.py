"""$lookup and $graphLookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestwright.functions.expressions import Val, compile_expression, step
from nestwright.functions.predicates import compile_filter
from nestwright.operators.shapes import env_of, shown, unwind
from nestwright.sources.shared import cut, stable


def _at(df: DataFrame, path: str) -> Val:
    head, *rest = path.split(".")
    types = {f.name: f.dataType for f in df.schema}
    return step(Val(F.col(f"`{head}`"), types[head]), rest, False) if head in types else Val(None)


def _whole(df: DataFrame) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in shown(df)))


def _check(spec: dict) -> tuple[str, str, str, str]:
    if {"let", "pipeline"} & set(spec):
        raise NotImplementedError("$lookup supports neither let nor pipeline")
    if "." in spec["as"]:
        raise NotImplementedError("$lookup supports no dotted 'as'")
    return spec["from"], spec["localField"], spec["foreignField"], spec["as"]


def _elements(v: Val) -> Column:
    """The values under which an array is found, a row each: its elements, or null if it is null itself."""
    return F.explode(F.when(v.col.isNull(), F.array(F.lit(None).cast(v.type.elementType))).otherwise(F.array_distinct(v.col)))


def _keys(df: DataFrame, path: str, name: str) -> DataFrame:
    """A row for each value under which df's rows can be found; missing is null."""
    v = _at(df, path)
    if v.missing:
        return df.withColumn(name, F.lit(None).cast("string"))
    return df.withColumn(name, _elements(v) if isinstance(v.type, T.ArrayType) else v.col)


def _is_array(df: DataFrame, path: str) -> bool:
    return isinstance(_at(df, path).type, T.ArrayType)


def _numbered(df: DataFrame) -> DataFrame:
    return df if "__seq" in df.columns else df.withColumn("__seq", F.monotonically_increasing_id())


def lookup(df: DataFrame, spec: dict, foreign: DataFrame) -> DataFrame:
    """Left outer join with the matches as an array, in the order of the foreign rows. Arrays on either side match by
    any element and are joined by their elements, so every form is an equi-join."""
    _, local, remote, name = _check(spec)
    foreign = _numbered(foreign)
    right = _keys(foreign.withColumn("__doc", _whole(foreign)), remote, "__key")
    mine = _at(df, local)
    if not mine.missing and isinstance(mine.type, T.ArrayType):
        df = stable(_numbered(df))
        pairs = df.select("__seq", _elements(mine).alias("__key")).join(right.select(F.col("__key").alias("__k"), F.col("__seq").alias("__rs"), "__doc"), F.col("__key").eqNullSafe(F.col("__k")))
        lists = pairs.groupBy("__seq").agg(F.array_sort(F.collect_set(F.struct("__rs", "__doc"))).alias("__l"))
        met = df.join(lists, "__seq", "left")
    else:
        lists = right.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct(F.col("__seq").alias("__rs"), "__doc"))).alias("__l"))
        key = (F.lit(None) if mine.missing else mine.col).cast(lists.schema["__key"].dataType)
        met = df.join(lists, key.eqNullSafe(F.col("__key")), "left").drop("__key")
    kind = T.ArrayType(foreign.select(_whole(foreign).alias("x")).schema["x"].dataType)
    found = F.coalesce(F.transform("__l", lambda r: r["__doc"]), F.array().cast(kind))
    return met.select(*(F.col(f"`{c}`") for c in df.columns if c != name), found.alias(name))


def flat(df: DataFrame, spec: dict, foreign: DataFrame, keep: bool) -> DataFrame:
    """$lookup whose array is only unwound: a plain join. A local array meets a foreign row once, whichever of its
    elements fit, so it takes the way through the list."""
    _, local, remote, name = _check(spec)
    if _is_array(df, local):
        return unwind(lookup(df, spec, foreign), {"path": f"${name}", "preserveNullAndEmptyArrays": keep})
    right = _keys(foreign.select(_whole(foreign).alias("__doc"), *(F.col(f"`{c}`") for c in shown(foreign))), remote, "__key").select("__key", "__doc")
    mine = _at(df, local)
    key = (F.lit(None) if mine.missing else mine.col).cast(right.schema["__key"].dataType)
    left = df.withColumn("__lk", key)
    met = left.join(right, F.col("__lk").eqNullSafe(F.col("__key")), "left" if keep else "inner")
    return met.select(*(F.col(f"`{c}`") for c in df.columns if c != name), F.col("__doc").alias(name))


def filtered(df: DataFrame, spec: dict, foreign: DataFrame, anti: bool) -> DataFrame:
    """$lookup whose array is only asked whether it is empty: a semi or anti join."""
    _, local, remote, name = _check(spec)
    if _is_array(df, local):
        n = F.size(F.col(f"`{name}`"))
        return lookup(df, spec, foreign).where(n == 0 if anti else n > 0).drop(name)
    right = _keys(foreign, remote, "__key").select("__key").distinct()
    mine = _at(df, local)
    key = (F.lit(None) if mine.missing else mine.col).cast(right.schema["__key"].dataType)
    return df.withColumn("__lk", key).join(right, F.col("__lk").eqNullSafe(F.col("__key")), "left_anti" if anti else "left_semi").drop("__lk", name)


def counted(df: DataFrame, spec: dict, foreign: DataFrame) -> DataFrame:
    """$lookup whose array is only asked for its size: the number of matches, counted by key before the join."""
    _, local, remote, name = _check(spec)
    if _is_array(df, local):
        out = lookup(df, spec, foreign)
        return out.withColumn(name, F.size(F.col(f"`{name}`")))
    right = _keys(foreign, remote, "__key").groupBy("__key").agg(F.count("*").cast("int").alias("__n"))
    mine = _at(df, local)
    key = (F.lit(None) if mine.missing else mine.col).cast(right.schema["__key"].dataType)
    met = df.withColumn("__lk", key).join(right, F.col("__lk").eqNullSafe(F.col("__key")), "left")
    return met.select(*(F.col(f"`{c}`") for c in df.columns if c != name), F.coalesce("__n", F.lit(0)).alias(name))


def graph_lookup(df: DataFrame, spec: dict, foreign: DataFrame) -> DataFrame:
    """Breadth first from startWith, level by level: a join on the frontier and an anti join on what was reached."""
    name, deepest, depth_field = spec["as"], spec.get("maxDepth"), spec.get("depthField")
    df, foreign = stable(_numbered(df)), _numbered(foreign)
    if "restrictSearchWithMatch" in spec:
        foreign = foreign.where(compile_filter(spec["restrictSearchWithMatch"], env_of(foreign)))
    start = compile_expression(spec["startWith"], env_of(df))
    if start.missing:
        return df
    onward = env_of(foreign).path(spec["connectFromField"])
    spread = lambda v: F.explode(v.col) if isinstance(v.type, T.ArrayType) else v.col
    right = cut(_keys(foreign.select("*", _whole(foreign).alias("__doc"), (F.lit(None) if onward.missing else onward.col).alias("__on")), spec["connectToField"], "__key").select(F.col("__seq").alias("__rs"), "__key", "__doc", "__on"))
    frontier = df.select("__seq", spread(start).alias("__v"))
    reached, depth = None, 0
    while True:
        met = frontier.distinct().join(right, F.col("__v").eqNullSafe(F.col("__key"))).select("__seq", "__rs", "__doc", "__on").dropDuplicates(["__seq", "__rs"])
        if reached is not None:
            met = met.join(reached.select("__seq", "__rs"), ["__seq", "__rs"], "left_anti")
        met = cut(met.withColumn("__depth", F.lit(depth).cast("bigint")))
        reached = met if reached is None else reached.unionByName(met)
        if met.isEmpty() or (deepest is not None and depth >= deepest) or onward.missing:
            break
        depth += 1
        frontier = met.select("__seq", spread(Val(F.col("__on"), onward.type)).alias("__v"))
    kind = right.schema["__doc"].dataType
    doc = F.struct(*(F.col("__doc").getField(f.name).alias(f.name) for f in kind), *([F.col("__depth").alias(depth_field)] if depth_field else []))
    lists = reached.groupBy("__seq").agg(F.array_sort(F.collect_list(F.struct("__depth", "__rs", doc.alias("d")))).alias("__l"))
    full = T.ArrayType(T.StructType([*kind.fields, *([T.StructField(depth_field, T.LongType())] if depth_field else [])]))
    met = df.join(lists, "__seq", "left")
    return met.select(*(F.col(f"`{c}`") for c in df.columns if c != name), F.coalesce(F.transform("__l", lambda r: r["d"]), F.array().cast(full)).alias(name))
