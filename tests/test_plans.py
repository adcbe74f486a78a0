"""What reaches the scan, and what the plans must not hold."""

import os
import re

import pytest

from nestwright.plans.pipeline import key_order, reads, rewrite, run, stages
from nestwright.plans.queries import QUERIES
from nestwright.sources.collections import Client

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(autouse=True)
def whole_lines(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pushed(df):
    return " ".join(re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", plan(df)))


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


@pytest.mark.parametrize(
    ("spec", "want"),
    [
        ({"o_orderkey": {"$gt": 5}}, ["GreaterThan(o_orderkey,5)"]),
        ({"o_orderkey": {"$gte": 5, "$lt": 9}}, ["GreaterThanOrEqual(o_orderkey,5)", "LessThan(o_orderkey,9)"]),
        ({"o_orderstatus": {"$in": ["F", "O"]}}, ["In(o_orderstatus, [F,O])"]),
        ({"$and": [{"o_orderkey": {"$lte": 5}}, {"o_orderstatus": "F"}]}, ["LessThanOrEqual(o_orderkey,5)", "o_orderstatus,F"]),
        ({"$or": [{"o_orderkey": {"$lt": 5}}, {"o_orderstatus": "F"}]}, ["Or(LessThan(o_orderkey,5)"]),
        ({"o_totalprice": {"$gt": 1000.5}, "o_orderkey": 7}, ["GreaterThan(o_totalprice,1000.5)", "o_orderkey,7"]),
    ],
)
def test_filters_reach_the_scan(spark, spec, want):
    for df in (
        run(table(spark, "orders"), [{"$match": spec}]),
        run(table(spark, "orders"), [{"$match": spec}, {"$group": {"_id": "$o_orderstatus", "x": {"$first": "$o_custkey"}}}]),
        Client(spark)["d"].load("orders", table(spark, "orders")).find(spec).df,
    ):
        assert all(w in pushed(df) for w in want), pushed(df)
    shape = [{"$match": spec}, {"$addFields": {"keys": {"$split": ["$o_orderpriority", "-"]}}}, {"$lookup": {"from": "customer", "localField": "keys", "foreignField": "c_name", "as": "c"}}]
    assert all(w in pushed(run(table(spark, "orders"), shape, lambda n: table(spark, n))) for w in want)


def test_only_the_columns_asked_for_are_read(spark):
    df = run(table(spark, "orders"), [{"$match": {"o_orderkey": {"$lt": 9}}}, {"$project": {"o_custkey": 1}}])
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>", plan(df))


@pytest.mark.parametrize("name", ["group_first_last", "group_mixed_order", "lookup_count", "lookup_semi", "lookup_anti", "lookup_unwind_join", "null_addtoset_size"])
def test_no_group_is_gathered(spark, name):
    assert "collect_" not in plan(QUERIES[name](spark, DATA))


def test_groups_are_sorted_only_where_it_is_seen(spark):
    group = {"$group": {"_id": "$o_custkey", "n": {"$sum": 1}}}
    ranged = lambda *more: "rangepartitioning" in plan(run(table(spark, "orders"), [group, *more]))
    assert ranged() and ranged({"$limit": 3}, {"$project": {"n": 1}}) is not None
    assert not ranged({"$count": "n"}) and not ranged({"$match": {"n": {"$gt": 3}}}, {"$group": {"_id": None, "m": {"$max": "$n"}}})
    assert key_order([("$match", {}), ("$limit", 3)]) and not key_order([("$project", {}), ("$sort", {})])


def test_rewrites():
    look = {"$lookup": {"from": "f", "localField": "a", "foreignField": "b", "as": "o"}}
    names = lambda *p: [n for n, _ in rewrite(stages(list(p)))]
    assert names(look, {"$unwind": "$o"}) == ["join"]
    assert names(look, {"$match": {"o": []}}, {"$project": {"a": 1}}) == ["semi", "$project"]
    assert names(look, {"$match": {"o": []}}, {"$project": {"a": 1, "o.x": 1}})[0] == "$lookup"
    assert names(look, {"$match": {"o": []}}, {"$project": {"a": "$$ROOT"}})[0] == "$lookup"
    assert names(look, {"$match": {"o": []}}, {"$project": {"a": {"$size": "$o"}}})[0] == "$lookup"
    assert names(look, {"$project": {"n": {"$size": "$o"}}}) == ["counted", "$project"]
    assert names(look, {"$project": {"n": {"$size": "$o"}, "o": 1}})[0] == "$lookup"
    assert names(look, {"$match": {"c": 1}}) == ["$match", "$lookup"]
    assert names({"$unwind": "$w"}, {"$match": {"c": 1}}) == ["$match", "$unwind"]
    assert names({"$unwind": {"path": "$w", "includeArrayIndex": "i"}}, {"$match": {"i": 1}}) == ["$unwind", "$match"]
    assert rewrite(stages([{"$group": {"_id": "$k", "s": {"$addToSet": "$v"}}}, {"$project": {"n": {"$size": "$s"}}}])) == [("$group", {"_id": "$k", "s": {"$addToSet size": "$v"}}), ("$project", {"n": "$s"})]
    assert reads({"$add": ["$a.b", {"$literal": "$c"}, "$$ROOT.d", ["$e"]]}) == {"a", "d", "e"} and reads("$$CURRENT") == {"$$ROOT"}
