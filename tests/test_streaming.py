"""Pipelines over a file stream against the same pipelines over the whole table."""

import datetime

import pytest

from nestwright.plans.pipeline import run
from nestwright.sources.collections import Client
from nestwright.streaming.pipelines import filtered, stream, upsert

SCHEMA = "id bigint, ts timestamp, kind string, value double"
GROUP = [{"$match": {"value": {"$gt": 2}}}, {"$group": {"_id": "$kind", "n": {"$sum": 1}, "s": {"$sum": "$value"}, "hi": {"$max": "$value"}}}, {"$addFields": {"mean": {"$divide": ["$s", "$n"]}}}]


@pytest.fixture
def folder(spark, tmp_path):
    path = str(tmp_path / "in")
    start = datetime.datetime(2024, 1, 1)
    for part in range(3):
        rows = [(i, start + datetime.timedelta(minutes=i), "abc"[i % 3], float(i % 7)) for i in range(part * 50, part * 50 + 50)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def finish(spark, df, name, tmp_path, mode):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
    return spark.table(name)


def test_group(spark, folder, tmp_path):
    got = finish(spark, stream(source(spark, folder), GROUP), "groups", tmp_path, "complete")
    want = run(spark.read.schema(SCHEMA).parquet(folder), GROUP)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_windows_with_a_watermark(spark, folder, tmp_path):
    per_hour = [{"$group": {"_id": "$window", "n": {"$sum": 1}}}]
    got = finish(spark, stream(source(spark, folder), per_hour, ("ts", "1 minute"), ("ts", "1 hour")), "windows", tmp_path, "append").collect()
    assert sorted((r["_id"].start.hour, r["n"]) for r in got) == [(0, 60), (1, 60)]  # the last hour is still open


def test_rows(spark, folder, tmp_path):
    rows = [{"$match": {"kind": {"$in": ["a", "b"]}}}, {"$project": {"id": 1, "twice": {"$multiply": ["$value", 2]}}}]
    got = finish(spark, stream(source(spark, folder), rows), "rows", tmp_path, "append")
    assert sorted(map(tuple, got.collect())) == sorted((i, float(i % 7) * 2) for i in range(150) if i % 3 < 2)
    assert filtered(spark.read.schema(SCHEMA).parquet(folder), {"id": {"$lt": 9}}).count() == 9


def test_into_a_collection(spark, folder, tmp_path):
    c = Client(spark)["d"]["sums"]
    q = stream(source(spark, folder), GROUP[:2]).writeStream.outputMode("update").foreachBatch(upsert(c)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = run(spark.read.schema(SCHEMA).parquet(folder), GROUP[:2])
    assert sorted((d["_id"], d["n"], d["s"]) for d in c.find()) == sorted((r["_id"], r["n"], r["s"]) for r in want.collect())


def test_refused(spark, folder):
    df = source(spark, folder)
    for wrong in ([{"$sort": {"id": 1}}], [{"$limit": 3}], [{"$group": {"_id": "$kind", "x": {"$first": "$id"}}}], [{"$group": {"_id": "$kind"}}, {"$group": {"_id": None}}]):
        with pytest.raises(NotImplementedError):
            stream(df, wrong)
    with pytest.raises(ValueError):
        stream(spark.read.schema(SCHEMA).parquet(folder), [])
