"""Pipelines: validated, rewritten, and folded over a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestwright.errors import OperationFailure
from nestwright.functions import mixed
from nestwright.functions.expressions import Val, compile_expression
from nestwright.functions.mixed import is_mixed
from nestwright.functions.predicates import compile_filter
from nestwright.operators import groups, joins, shapes
from nestwright.operators.shapes import env_of, hidden, shown
from nestwright.sources.shared import cut

UNSUPPORTED = set("$bucketAuto $collStats $currentOp $geoNear $indexStats $listLocalSessions $listSessions $merge $planCacheStats $redact $replaceWith $sortByCount $unset".split())
STAGES = set("$match $project $addFields $set $group $bucket $sort $limit $skip $count $unwind $lookup $graphLookup $replaceRoot $facet $sample $out".split())
Resolve = Callable[[str], DataFrame]


def stages(pipeline: list[dict]) -> list[tuple[str, object]]:
    """One (name, options) per stage; unknown and unsupported ones raise before anything runs."""
    out = []
    for stage in pipeline:
        for name, options in stage.items():
            if name in UNSUPPORTED:
                raise NotImplementedError(f"the stage {name} is not supported")
            if name not in STAGES:
                raise NotImplementedError(f"{name} is not a valid stage")
            out.append((name, options))
    return out


def reads(e) -> set[str]:
    """Names of the fields that an expression reads; `$$ROOT` for the whole document."""
    if isinstance(e, str) and e.startswith("$$"):
        head, _, rest = e[2:].partition(".")
        return ({rest.split(".")[0]} if rest else {"$$ROOT"}) if head in ("ROOT", "CURRENT") else set()
    if isinstance(e, str) and e.startswith("$"):
        return {e[1:].split(".")[0]}
    if isinstance(e, dict):
        return set().union(*(reads(x) for k, x in e.items() if k != "$literal"))
    return set().union(*map(reads, e)) if isinstance(e, list | tuple) else set()


def _without(field: str, stage: tuple[str | None, object]) -> bool:
    """Whether a stage is a projection of named fields that neither keeps nor reads a field."""
    name, spec = stage
    if name != "$project" or not any(v not in (0, False) for k, v in spec.items() if k != "_id"):
        return False
    return not any(k.split(".")[0] == field for k in spec) and not reads(list(spec.values())) & {field, "$$ROOT"}


def _sized(field: str, stage: tuple[str | None, object]) -> dict | None:
    """The projection with the field for {$size: field}, if that is all it asks of the field; else None."""
    name, spec = stage
    size = {"$size": f"${field}"}
    if name != "$project" or size not in spec.values():
        return None
    made = {k: f"${field}" if v == size else v for k, v in spec.items()}
    return made if _without(field, (name, {k: v for k, v in spec.items() if v != size} | {"__size": 1})) else None


def rewrite(plan: list[tuple[str, object]]) -> list[tuple[str, object]]:
    """$lookup that is only unwound becomes a join; one that is only asked for emptiness and then dropped, a semi or
    anti join; one that is only asked for its size, a count by key; $addToSet that is only asked for its size, a
    distinct count. A filter on other fields moves before a lookup or an unwind."""
    out, i = [], 0
    while i < len(plan):
        name, options = plan[i]
        after = plan[i + 1] if i + 1 < len(plan) else (None, None)
        last = plan[i + 2] if i + 2 < len(plan) else (None, None)
        if name == "$lookup" and after[0] == "$unwind":
            u = {"path": after[1]} if isinstance(after[1], str) else after[1]
            if u["path"] == f"${options['as']}" and not u.get("includeArrayIndex"):
                out.append(("join", (options, bool(u.get("preserveNullAndEmptyArrays")))))
                i += 2
                continue
        if name == "$lookup" and after[0] == "$match" and isinstance(after[1], dict):
            field = options["as"]
            anti = {repr([]): True, repr({"$size": 0}): True, repr({"$ne": []}): False}.get(repr(after[1].get(field)))
            if len(after[1]) == 1 and anti is not None and _without(field, last):
                out.append(("semi", (options, anti)))
                i += 2
                continue
        if name == "$lookup" and (sized := _sized(options["as"], after)):
            out += [("counted", options), ("$project", sized)]
            i += 2
            continue
        if name == "$group" and after[0] == "$project":
            options, project = dict(options), after[1]
            for k, acc in options.items():
                if k != "_id" and isinstance(acc, dict) and set(acc) == {"$addToSet"} and (sized := _sized(k, (after[0], project))):
                    options[k], project = {groups.COUNT_SET: acc["$addToSet"]}, sized
            out.append((name, options))
            plan = [*plan[: i + 1], ("$project", project), *plan[i + 2 :]]
            i += 1
            continue
        if name in ("$lookup", "$unwind") and after[0] == "$match" and isinstance(after[1], dict) and after[1]:
            u = {"path": options} if isinstance(options, str) else options
            made = {options["as"]} if name == "$lookup" else {str(u["path"])[1:].split(".")[0], u.get("includeArrayIndex")}
            if not any(k.startswith("$") or k.split(".")[0] in made for k in after[1]):
                out.append(after)
                plan = [*plan[: i + 1], *plan[i + 2 :]]
                continue
        out.append((name, options))
        i += 1
    return out


def needs_order(plan: list[tuple[str, object]]) -> bool:
    """Whether some stage asks for the order of rows, so that they must be numbered."""
    for name, options in plan:
        if name in ("$lookup", "$graphLookup"):
            return True
        if name in ("$group", "$bucket") and any(isinstance(a, dict) and set(a) & groups.ORDERED for a in (options if name == "$group" else options.get("output", {})).values()):
            return True
        if name == "$facet":
            return True
    return False


def key_order(rest: list[tuple[str, object]]) -> bool:
    """Whether the key order of a group's rows is seen after the stages that follow it."""
    for name, options in rest:
        if name in ("$sort", "$count", "$sample") or name in ("$group", "$bucket") and not needs_order([(name, options)]):
            return False
        if name not in ("$match", "$project", "$addFields", "$set", "$unwind", "$replaceRoot", "join", "semi", "counted"):
            return True
    return True


def sort_keys(df: DataFrame, spec: dict, adds: bool) -> tuple[DataFrame, list, groups.Order]:
    """Sort columns for a specification; with `adds`, hidden columns that keep the order for later stages."""
    order, keys, made = [], [], {}
    for n, (path, way) in enumerate(spec.items()):
        if path.startswith("$") and path != "$natural":
            raise NotImplementedError(f"sorting by {path} is not supported")
        if way not in (1, -1):
            raise OperationFailure("a sort direction is 1 or -1")
        v = Val(F.col("__seq"), T.LongType()) if path == "$natural" else env_of(df).path(path)
        if v.missing:
            continue
        cols = [groups.comparable_key(v) if groups.has_mixed(v.type) else v.col]
        if is_mixed(v.type):  # arrays as below
            listed = mixed.elements(v.col)
            cols = [F.when(F.size(listed) == 0, 0).otherwise(1), mixed.key(F.coalesce(F.get(listed, F.lit(0)), v.col))]
        if isinstance(v.type, T.ArrayType):  # empty before null, otherwise by the first element
            cols = [F.when(F.size(v.col) == 0, 0).otherwise(1), F.get(v.col, F.lit(0))]
        for m, c in enumerate(cols):
            keys.append(c.asc_nulls_first() if way == 1 else c.desc_nulls_last())
            if adds:
                made[f"__k{n}_{m}"] = c
                order.append((f"__k{n}_{m}", way == 1))
    if adds:
        df = df.drop(*[c for c in df.columns if c.startswith("__k")]).withColumns(made)
    return df, keys, order


def run(df: DataFrame, pipeline: list[dict], resolve: Resolve | None = None, write: Callable[[str, DataFrame], None] | None = None) -> DataFrame:
    """The pipeline's result. resolve gives other collections by name, write stores one."""
    plan = rewrite(stages(pipeline))
    numbered = needs_order(plan)
    while numbered and plan[0][0] == "$match":  # before rows are numbered, so that the filter reaches the scan
        df, plan = df.where(compile_filter(plan[0][1], env_of(df))), plan[1:]
    if numbered and "__seq" not in df.columns:
        df = df.withColumn("__seq", F.monotonically_increasing_id())
    order: groups.Order = [("__seq", True)]
    for i, (name, options) in enumerate(plan):
        later = needs_order(plan[i + 1 :])
        if name == "$match":
            df = df.where(compile_filter(options, env_of(df)))
        elif name == "$project":
            df = shapes.project(df, options)
        elif name in ("$addFields", "$set"):
            df = shapes.add_fields(df, options)
        elif name == "$unwind":
            df = shapes.unwind(df, options)
        elif name == "$sort":
            df, keys, by = sort_keys(df, options, later)
            if later:
                order = [*by, ("__seq", True)]
            df = df.orderBy(*keys, *([F.col("__seq")] if "__seq" in df.columns else []))
        elif name in ("$limit", "$skip"):
            if not isinstance(options, int) or options < 0:
                raise OperationFailure(f"{name} needs a number that isn't negative")
            df = df.limit(options) if name == "$limit" else df.offset(options)
        elif name == "$count":
            if not isinstance(options, str) or not options or options.startswith("$") or "." in options:
                raise OperationFailure("the count field must be a plain name")
            df = df.agg(F.count("*").alias(options))
        elif name == "$group":
            df = groups.group(df, options, order, later or key_order(plan[i + 1 :]))
        elif name == "$bucket":
            df = groups.bucket(df, options, order)
        elif name == "$replaceRoot":
            v = compile_expression(options["newRoot"], env_of(df))
            if v.missing or not isinstance(v.type, T.StructType):
                raise OperationFailure("'newRoot' expression must evaluate to an object")
            whole = F.when(v.col.isNull(), F.raise_error(F.lit("'newRoot' expression must evaluate to an object")).cast(v.type)).otherwise(v.col)
            df = df.select(whole.alias("__root"), *hidden(df)).select("__root.*", *hidden(df))
        elif name == "$lookup":
            df = joins.lookup(df, options, resolve(options["from"]))
        elif name == "join":
            df = joins.flat(df, options[0], resolve(options[0]["from"]), options[1])
        elif name == "semi":
            df = joins.filtered(df, options[0], resolve(options[0]["from"]), options[1])
        elif name == "counted":
            df = joins.counted(df, options, resolve(options["from"]))
        elif name == "$graphLookup":
            df = joins.graph_lookup(df, options, resolve(options["from"]))
        elif name == "$facet":
            if len(options) > 1 and any(x not in ("$match", "$project") for x, _ in plan[:i]):
                df = cut(df)  # computed once for all facets; a plain scan is left to each, with its own filters and columns
            df = _facet(df, options, resolve, write)
        elif name == "$sample":
            if set(options) != {"size"}:
                raise OperationFailure("$sample needs a size")
            df = df.orderBy(F.rand()).limit(options["size"])
        elif name == "$out":
            write(options, df.select(*(F.col(f"`{c}`") for c in shown(df))))
        if name in ("$group", "$bucket", "$count", "$facet") and later:
            df, order = df.withColumn("__seq", F.monotonically_increasing_id()), [("__seq", True)]
    return df.select(*(F.col(f"`{c}`") for c in shown(df)))


def _facet(df: DataFrame, options: dict, resolve, write) -> DataFrame:
    """One row with an array for each sub-pipeline. Its arrays are whole results by definition, so they meet in a row."""
    out = None
    for name, sub in options.items():
        part = run(df, sub, resolve, write)
        rows = part.withColumn("__seq", F.monotonically_increasing_id())
        kind = T.ArrayType(part.schema)
        one = rows.agg(F.array_sort(F.collect_list(F.struct("__seq", F.struct(*(F.col(f"`{c}`") for c in part.columns)).alias("d")))).alias("l")).select(F.coalesce(F.transform("l", lambda r: r["d"]), F.array().cast(kind)).alias(name))
        out = one if out is None else out.crossJoin(one)  # one row on either side
    return out
