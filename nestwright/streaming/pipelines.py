"""Pipelines over streams: the stages that need no order of rows and no whole result run on each batch as it comes, and
groups are kept by Spark's state store. Late rows are told by a watermark on a time field."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestwright.operators import groups
from nestwright.operators.shapes import env_of, shown
from nestwright.functions.predicates import compile_filter
from nestwright.plans import pipeline as plans
from nestwright.sources.collections import Collection

#: Stages that work row by row; a group may follow them once.
ROW_STAGES = {"$match", "$project", "$addFields", "$set", "$unwind", "$replaceRoot"}


def stream(df: DataFrame, pipeline: list[dict], watermark: tuple[str, str] | None = None, window: tuple[str, str] | None = None) -> DataFrame:
    """The pipeline's result as a stream. watermark: a time field and how late rows may be. window: a time field and a
    length; it adds the field `window` (start, end), by which a group can be made."""
    if not df.isStreaming:
        raise ValueError("the input is no stream")
    plan = plans.rewrite(plans.stages(pipeline))
    at = next((i for i, (name, _) in enumerate(plan) if name == "$group"), len(plan))
    for i, (name, options) in enumerate(plan):
        if i != at and name not in ROW_STAGES:
            raise NotImplementedError(f"{name} is not supported on a stream")
        if name == "$group" and plans.needs_order([(name, options)]):
            raise NotImplementedError("accumulators that go by the order of rows are not supported on a stream")
    if watermark:
        df = df.withWatermark(*watermark)
    if window:
        df = df.withColumn("window", F.window(*window))
    before = [{name: options} for name, options in plan[:at]]
    df = plans.run(df, before) if before else df
    if at == len(plan):
        return df
    df = groups.group(df, plan[at][1], [], False)
    rest = [{name: options} for name, options in plan[at + 1 :]]
    return plans.run(df, rest) if rest else df


def upsert(collection: Collection, key: str = "_id") -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: a batch's rows take the place of the collection's rows with their key, so that a
    batch that comes again after a failure changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.dropDuplicates([key])
        if collection._df is None:
            collection.insert_df(batch)
            return
        old = collection.find().df
        kept = old.join(batch.select(F.col(key).alias("__key")), old[key].eqNullSafe(F.col("__key")), "left_anti")
        collection._replace_all(kept.unionByName(batch.select(*(F.col(f"`{c}`") for c in shown(batch))), allowMissingColumns=True))

    return write


def filtered(df: DataFrame, filter_: dict) -> DataFrame:
    """The rows of a stream, or of a table, that a filter keeps."""
    return df.where(compile_filter(filter_, env_of(df)))
