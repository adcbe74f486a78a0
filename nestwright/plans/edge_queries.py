"""Queries whose inputs hold nulls, arrays and objects, made inside the query, and queries of single calls of a collection."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestwright.errors import BulkWriteError, DuplicateKeyError
from nestwright.plans.queries import add, collection
from nestwright.sources.results import DeleteOne, InsertOne, ReplaceOne, UpdateMany, UpdateOne

# Nulls: v is the quantity on lines 1 to 3 and null on others ---------------------------------------
_V = {"$addFields": {"v": {"$cond": [{"$lte": ["$l_linenumber", 3]}, "$l_quantity", None]}}}
_VS = "(SELECT *, CASE WHEN l_linenumber <= 3 THEN l_quantity END AS v FROM lineitem)"
for _name, _spec, _where in (
    ("eq", {"v": None}, "v IS NULL"),
    ("ne", {"v": {"$ne": None}}, "v IS NOT NULL"),
    ("ne_value", {"v": {"$ne": 5}}, "v IS DISTINCT FROM 5"),
    ("gt", {"v": {"$gt": 30}}, "v > 30"),
    ("gte_null", {"v": {"$gte": None}}, "v IS NULL"),
    ("not_gt", {"v": {"$not": {"$gt": 30}}}, "v IS NULL OR v <= 30"),
    ("in", {"v": {"$in": [1, 2, None]}}, "v IN (1, 2) OR v IS NULL"),
    ("nin", {"v": {"$nin": [1, 2]}}, "v IS NULL OR v NOT IN (1, 2)"),
    ("nin_null", {"v": {"$nin": [1, None]}}, "v <> 1"),
    ("nor", {"$nor": [{"v": {"$lt": 10}}, {"l_linenumber": 7}]}, "coalesce(v >= 10, true) AND l_linenumber <> 7"),
    ("or", {"$or": [{"v": {"$lt": 5}}, {"l_linenumber": 7}]}, "v < 5 OR l_linenumber = 7"),
    ("type", {"v": {"$type": "double"}}, "v IS NOT NULL"),
    ("regex", {"v": {"$not": {"$regex": "x"}}}, "true"),
    ("expr", {"$expr": {"$lt": ["$v", 10]}}, "v IS NULL OR v < 10"),
):
    add(f"null_match_{_name}", "lineitem", [_V, {"$match": _spec}, {"$project": {"l_orderkey": 1, "l_linenumber": 1}}], f"SELECT l_orderkey, l_linenumber FROM {_VS} WHERE {_where}")

for _name, _e, _sql in (
    ("add", {"$add": ["$v", 1]}, "v + 1"),
    ("ifnull", {"$ifNull": ["$v", -1.0]}, "coalesce(v, -1)"),
    ("cond", {"$cond": ["$v", 1, 0]}, "CASE WHEN v <> 0 THEN 1 ELSE 0 END"),
    ("gt", {"$gt": ["$v", None]}, "v IS NOT NULL"),
    ("lt", {"$lt": ["$v", 20]}, "v IS NULL OR v < 20"),
    ("eq", {"$eq": ["$v", None]}, "v IS NULL"),
    ("not", {"$not": "$v"}, "v IS NULL OR v = 0"),
    ("and", {"$and": ["$v", "$l_tax"]}, "coalesce(v <> 0, false) AND l_tax <> 0"),
    ("isnumber", {"$isNumber": "$v"}, "v IS NOT NULL"),
    ("sum", {"$sum": ["$v", "$l_linenumber"]}, "coalesce(v, 0) + l_linenumber"),
    ("max", {"$max": ["$v", 25.0]}, "greatest(v, 25)"),
    ("concat", {"$concat": ["a", {"$cond": [{"$gt": ["$v", None]}, "b", None]}]}, "CASE WHEN v IS NOT NULL THEN 'ab' END"),
    ("lower", {"$toLower": {"$cond": [{"$gt": ["$v", None]}, "B", None]}}, "CASE WHEN v IS NOT NULL THEN 'b' ELSE '' END"),
    ("isarray", {"$isArray": {"$cond": [{"$gt": ["$v", None]}, {"$split": ["$l_returnflag", " "]}, None]}}, "v IS NOT NULL"),
    ("switch", {"$switch": {"branches": [{"case": {"$gt": ["$v", 25]}, "then": "many"}, {"case": {"$eq": ["$v", None]}, "then": None}], "default": "few"}}, "CASE WHEN v > 25 THEN 'many' WHEN v IS NULL THEN NULL ELSE 'few' END"),
):
    add(f"null_expr_{_name}", "lineitem", [_V, {"$project": {"l_orderkey": 1, "l_linenumber": 1, "x": _e}}], f"SELECT l_orderkey, l_linenumber, {_sql} AS x FROM {_VS}")

add("null_group_key", "lineitem", [_V, {"$group": {"_id": "$v", "n": {"$sum": 1}, "top": {"$max": "$l_shipdate"}}}], f"SELECT v AS _id, count(*) AS n, max(l_shipdate) AS top FROM {_VS} GROUP BY 1")
add("null_group_values", "lineitem", [_V, {"$group": {"_id": "$l_linenumber", "s": {"$sum": "$v"}, "a": {"$avg": "$v"}, "lo": {"$min": "$v"}, "hi": {"$max": "$v"}}}], f"SELECT l_linenumber AS _id, coalesce(sum(v), 0) AS s, round(avg(v), 4) AS a, min(v) AS lo, max(v) AS hi FROM {_VS} GROUP BY 1", lambda df: df.withColumn("a", F.round("a", 4)))
add("null_sort", "lineitem", [_V, {"$sort": {"v": 1, "l_orderkey": 1, "l_linenumber": 1, "l_partkey": 1, "l_extendedprice": 1}}, {"$skip": 20}, {"$limit": 30}, {"$project": {"l_orderkey": 1, "v": 1}}], f"SELECT l_orderkey, v FROM {_VS} ORDER BY v NULLS FIRST, l_orderkey, l_linenumber, l_partkey, l_extendedprice LIMIT 30 OFFSET 20")
add("null_first_last", "lineitem", [_V, {"$sort": {"v": -1, "l_shipdate": 1, "l_orderkey": -1, "l_partkey": 1}}, {"$group": {"_id": "$l_returnflag", "first": {"$first": "$l_orderkey"}, "last": {"$last": "$l_orderkey"}, "none": {"$last": "$v"}}}], f"SELECT l_returnflag AS _id, first(l_orderkey ORDER BY v DESC NULLS LAST, l_shipdate, l_orderkey DESC, l_partkey) AS first, last(l_orderkey ORDER BY v DESC NULLS LAST, l_shipdate, l_orderkey DESC, l_partkey) AS last, last(v ORDER BY v DESC NULLS LAST, l_shipdate, l_orderkey DESC, l_partkey) AS none FROM {_VS} GROUP BY 1")
add("null_addtoset_size", "lineitem", [_V, {"$group": {"_id": "$l_returnflag", "set": {"$addToSet": "$v"}}}, {"$project": {"_id": 1, "n": {"$size": "$set"}}}], f"SELECT l_returnflag AS _id, CAST(count(DISTINCT v) + 1 AS INTEGER) AS n FROM {_VS} GROUP BY 1")
add("addtoset_order", "orders", [{"$sort": {"o_orderkey": -1}}, {"$group": {"_id": "$o_orderstatus", "set": {"$addToSet": "$o_orderpriority"}}}], "SELECT o_orderstatus AS _id, string_agg(o_orderpriority, ',' ORDER BY k DESC) AS set FROM (SELECT o_orderstatus, o_orderpriority, max(o_orderkey) AS k FROM orders GROUP BY 1, 2) GROUP BY 1", lambda df: df.withColumn("set", F.array_join("set", ",")))
add("group_mixed_order", "orders", [{"$sort": {"o_orderpriority": -1, "o_orderdate": 1, "o_orderkey": -1}}, {"$group": {"_id": "$o_orderstatus", "first": {"$first": "$o_orderkey"}, "last": {"$last": "$o_orderkey"}}}], "SELECT o_orderstatus AS _id, first(o_orderkey ORDER BY o_orderpriority DESC, o_orderdate, o_orderkey DESC) AS first, last(o_orderkey ORDER BY o_orderpriority DESC, o_orderdate, o_orderkey DESC) AS last FROM orders GROUP BY 1")
add("group_then_count", "orders", [{"$group": {"_id": "$o_custkey", "n": {"$sum": 1}}}, {"$match": {"n": {"$gt": 9}}}, {"$count": "busy"}], "SELECT count(*) AS busy FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 9)")
add("unwind_then_match", "part", [{"$addFields": {"w": {"$split": ["$p_name", " "]}}}, {"$unwind": "$w"}, {"$match": {"p_size": {"$lt": 20}}}, {"$group": {"_id": "$w", "n": {"$sum": 1}}}], "SELECT w AS _id, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part WHERE p_size < 20) GROUP BY 1")

# Times --------------------------------------------------------------------------------------------
for _name, _e, _sql in (
    ("hour", {"$hour": "$ts"}, "hour(ts)"),
    ("minute", {"$minute": "$ts"}, "minute(ts)"),
    ("second", {"$second": "$ts"}, "second(ts)"),
    ("millisecond", {"$millisecond": "$ts"}, "millisecond(ts) % 1000"),
    ("hour_timezone", {"$hour": {"date": "$ts", "timezone": "Asia/Tokyo"}}, "hour(ts + INTERVAL 9 HOUR)"),
    ("minute_timezone", {"$minute": {"date": "$ts", "timezone": "Asia/Kolkata"}}, "minute(ts + INTERVAL 330 MINUTE)"),
):
    add(f"expr_{_name}", "events", [{"$project": {"event_id": 1, "x": _e}}], f"SELECT event_id, CAST({_sql} AS INTEGER) AS x FROM events")

# Joins --------------------------------------------------------------------------------------------
# keys: two numbers of nations, null for region 4, empty for region 3.
_KEYS = {"$addFields": {"keys": {"$cond": [{"$eq": ["$r_regionkey", 4]}, None, {"$filter": {"input": {"$map": {"input": {"$split": [{"$concat": [{"$toString": "$r_regionkey"}, ",", "7,7"]}, ","]}, "in": {"$toInt": "$$this"}}}, "cond": {"$ne": ["$r_regionkey", 3]}}}]}}}
_LOCAL = {"from": "nation", "localField": "keys", "foreignField": "n_nationkey", "as": "n"}
_PAIRS = "SELECT r_regionkey, n_nationkey FROM region JOIN nation ON n_nationkey IN (r_regionkey, 7) WHERE r_regionkey < 3"
add("lookup_local_array", "region", [_KEYS, {"$lookup": _LOCAL}, {"$project": {"r_regionkey": 1, "k": {"$size": "$n"}}}], f"SELECT r_regionkey, CAST(count(n_nationkey) AS INTEGER) AS k FROM region LEFT JOIN ({_PAIRS}) USING (r_regionkey) GROUP BY 1")
add("lookup_local_array_unwind", "region", [_KEYS, {"$lookup": _LOCAL}, {"$unwind": "$n"}, {"$project": {"r_regionkey": 1, "k": "$n.n_nationkey"}}], f"SELECT r_regionkey, n_nationkey AS k FROM ({_PAIRS})")
add("lookup_local_array_preserve", "region", [_KEYS, {"$lookup": _LOCAL}, {"$unwind": {"path": "$n", "preserveNullAndEmptyArrays": True}}, {"$project": {"r_regionkey": 1, "k": "$n.n_nationkey"}}], f"SELECT r_regionkey, n_nationkey AS k FROM region LEFT JOIN ({_PAIRS}) USING (r_regionkey)")
add("lookup_local_array_semi", "region", [_KEYS, {"$lookup": _LOCAL}, {"$match": {"n": {"$ne": []}}}, {"$project": {"r_regionkey": 1}}], "SELECT r_regionkey FROM region WHERE r_regionkey < 3")
add("lookup_semi_members", "customer", [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}}, {"$match": {"o": {"$ne": []}}}, {"$project": {"c_custkey": 1, "o.o_orderkey": 1}}, {"$unwind": "$o"}, {"$project": {"c_custkey": 1, "k": "$o.o_orderkey"}}], "SELECT o_custkey AS c_custkey, o_orderkey AS k FROM orders JOIN customer ON c_custkey = o_custkey")
add("lookup_semi_root", "customer", [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}}, {"$match": {"o": {"$ne": []}}}, {"$project": {"c_custkey": 1, "all": "$$ROOT"}}, {"$project": {"c_custkey": 1, "n": {"$size": "$all.o"}}}], "SELECT c_custkey, CAST(count(*) AS INTEGER) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
add("lookup_filter_first", "customer", [{"$lookup": {"from": "nation", "localField": "c_nationkey", "foreignField": "n_nationkey", "as": "n"}}, {"$match": {"c_acctbal": {"$gt": 9000}}}, {"$unwind": "$n"}, {"$project": {"c_custkey": 1, "name": "$n.n_name"}}], "SELECT c_custkey, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000")
add("lookup_null_keys", "customer", [{"$addFields": {"k": {"$cond": [{"$lt": ["$c_nationkey", 20]}, "$c_nationkey", None]}}}, {"$lookup": {"from": "nation", "localField": "k", "foreignField": "n_nationkey", "as": "n"}}, {"$project": {"c_custkey": 1, "m": {"$size": "$n"}}}], "SELECT c_custkey, CASE WHEN c_nationkey < 20 THEN 1 ELSE 0 END AS m FROM customer")
add("lookup_missing_local", "region", [{"$lookup": {"from": "nation", "localField": "nowhere", "foreignField": "n_name", "as": "n"}}, {"$project": {"r_name": 1, "m": {"$size": "$n"}}}], "SELECT r_name, CAST((SELECT count(*) FROM nation WHERE n_name IS NULL) AS INTEGER) AS m FROM region")


def _foreign(call):
    """A query over suppliers with a collection of tagged nations: tags are null, empty or hold key and key + 1."""

    def run(c) -> DataFrame:
        nations = c.find().df
        tags = F.when(F.col("n_nationkey") % 5 == 4, F.lit(None)).when(F.col("n_nationkey") % 5 == 3, F.array().cast("array<int>")).otherwise(F.array("n_nationkey", F.col("n_nationkey") + 1))
        c.database.load("tagged", nations.select("n_nationkey", tags.alias("tags")))
        return call(c)

    return run


_TAGGED = {"from": "tagged", "localField": "k", "foreignField": "tags", "as": "t"}
_TAGS = "(SELECT n_nationkey AS t, unnest([n_nationkey, n_nationkey + 1]) AS tag FROM nation WHERE n_nationkey % 5 < 3 UNION ALL SELECT n_nationkey, NULL FROM nation WHERE n_nationkey % 5 = 4)"
_K = {"$addFields": {"k": {"$cond": [{"$lt": ["$n_nationkey", 20]}, "$n_nationkey", None]}}}
_KS = "(SELECT n_nationkey, CASE WHEN n_nationkey < 20 THEN n_nationkey END AS k FROM nation)"
collection("lookup_foreign_array", "nation", _foreign(lambda c: c.aggregate_df([_K, {"$lookup": _TAGGED}, {"$project": {"n_nationkey": 1, "m": {"$size": "$t"}}}])), f"SELECT n_nationkey, CAST(count(t) AS INTEGER) AS m FROM {_KS} LEFT JOIN {_TAGS} ON k IS NOT DISTINCT FROM tag GROUP BY 1")
collection("lookup_foreign_array_list", "nation", _foreign(lambda c: c.aggregate_df([_K, {"$lookup": _TAGGED}, {"$project": {"n_nationkey": 1, "m": {"$map": {"input": "$t", "in": {"$toString": "$$this.n_nationkey"}}}}}]).withColumn("m", F.array_join("m", ","))), f"SELECT n_nationkey, coalesce(string_agg(t, ',' ORDER BY t), '') AS m FROM {_KS} LEFT JOIN {_TAGS} ON k IS NOT DISTINCT FROM tag GROUP BY 1")
collection("lookup_foreign_array_anti", "nation", _foreign(lambda c: c.aggregate_df([_K, {"$lookup": _TAGGED}, {"$match": {"t": []}}, {"$project": {"n_nationkey": 1}}])), f"SELECT n_nationkey FROM {_KS} a WHERE NOT EXISTS (SELECT 1 FROM {_TAGS} WHERE a.k IS NOT DISTINCT FROM tag)")

# Single calls of a collection ---------------------------------------------------------------------
_NATION = "n_nationkey, n_name, n_regionkey"


def _rows(c, rows: list[tuple], schema: str) -> DataFrame:
    return c._spark.createDataFrame(rows, schema)


def _then(*changes):
    """The documents after some calls, as the keys and values of what they hold."""

    def call(c):
        for change in changes:
            change(c)
        return c.find().df

    return call


def _words(c) -> None:
    """Gives the collection's parts their words as an array."""
    words = c.find().df.select("p_partkey", F.split("p_name", " ").alias("w"))
    c.database.load(c.name, words)


_W = "string_split(p_name, ' ')"
_joined = lambda df: df.withColumn("w", F.array_join("w", ","))
for _name, _change, _sql in (
    ("pull", lambda c: c.update_many({}, {"$pull": {"w": "ring"}}), f"list_filter({_W}, lambda x: x <> 'ring')"),
    ("pull_test", lambda c: c.update_many({"p_partkey": {"$lt": 500}}, {"$pull": {"w": {"$gte": "r"}}}), f"CASE WHEN p_partkey < 500 THEN list_filter({_W}, lambda x: x < 'r') ELSE {_W} END"),
    ("pullall", lambda c: c.update_many({}, {"$pullAll": {"w": ["ring", "small"]}}), f"list_filter({_W}, lambda x: x NOT IN ('ring', 'small'))"),
    ("addtoset", lambda c: c.update_many({}, {"$addToSet": {"w": "ring"}}), f"CASE WHEN list_contains({_W}, 'ring') THEN {_W} ELSE list_append({_W}, 'ring') END"),
    ("positional", lambda c: c.update_many({"w": "ring"}, {"$set": {"w.$": "RING"}}), f"CASE WHEN list_contains({_W}, 'ring') THEN {_W}[:list_position({_W}, 'ring') - 1] || ['RING'] || {_W}[list_position({_W}, 'ring') + 1:] ELSE {_W} END"),
):
    collection(f"update_{_name}", "part", lambda c, change=_change: _joined(_then(_words, change)(c)), f"SELECT p_partkey, array_to_string({_sql}, ',') AS w FROM part")

for _name, _spec, _sql in (
    ("slice", {"w": {"$slice": 1}}, f"SELECT p_partkey, array_to_string({_W}[:1], ',') AS w FROM part"),
    ("slice_last", {"w": {"$slice": [-1, 1]}}, f"SELECT p_partkey, array_to_string({_W}[-1:], ',') AS w FROM part"),
    ("elemmatch", {"p_partkey": 1, "w": {"$elemMatch": {"$gte": "r"}}}, f"SELECT p_partkey, list_filter({_W}, lambda x: x >= 'r')[1] AS w FROM part"),
):
    collection(f"find_{_name}", "part", lambda c, spec=_spec: (_words(c), _joined(c.find({}, spec).df))[1], _sql)

collection("update_upsert", "nation", _then(lambda c: c.update_one({"n_nationkey": 99}, {"$set": {"n_name": "new"}, "$setOnInsert": {"n_regionkey": 4}}, upsert=True), lambda c: c.update_one({"n_nationkey": 3}, {"$set": {"n_name": "old"}, "$setOnInsert": {"n_regionkey": 77}}, upsert=True), lambda c: c.database.load(c.name, c.find({}, {"_id": 0}).df)), "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'old' ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT 99, 'new', 4")
collection("update_current_date", "nation", _then(lambda c: c.update_many({"n_regionkey": 1}, {"$currentDate": {"at": True}})), f"SELECT {_NATION}, CASE WHEN n_regionkey = 1 THEN TIMESTAMP '2000-01-01' END AS at FROM nation")
collection("find_one_and_update", "nation", lambda c: (lambda before, after: _rows(c, [(before["n_name"], after["n_name"], c.count_documents({"n_name": "x"}))], "before string, after string, n bigint"))(c.find_one_and_update({"n_regionkey": 2}, {"$set": {"n_name": "x"}}, sort=[("n_nationkey", -1)]), c.find_one_and_update({"n_regionkey": 3}, {"$set": {"n_name": "x"}}, return_document=True)), "SELECT (SELECT n_name FROM nation WHERE n_regionkey = 2 ORDER BY n_nationkey DESC LIMIT 1) AS before, 'x' AS after, CAST(2 AS BIGINT) AS n")
collection("find_one_and_replace", "nation", _then(lambda c: c.find_one_and_replace({"n_nationkey": 5}, {"n_nationkey": 5, "n_name": "five"})), "SELECT n_nationkey, CASE WHEN n_nationkey = 5 THEN 'five' ELSE n_name END AS n_name, CASE WHEN n_nationkey <> 5 THEN n_regionkey END AS n_regionkey FROM nation")
collection("find_one_and_delete", "nation", _then(lambda c: c.find_one_and_delete({"n_regionkey": 1}, sort=[("n_nationkey", 1)])), f"SELECT {_NATION} FROM nation WHERE n_nationkey <> (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 1)")
collection("find_one", "nation", lambda c: _rows(c, [tuple(c.find_one({"n_regionkey": 2}, ["n_nationkey", "n_name"], sort=[("n_name", -1)]).values())], "n_nationkey int, n_name string"), "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2 ORDER BY n_name DESC LIMIT 1")
collection("count_documents", "lineitem", lambda c: _rows(c, [(c.count_documents({"l_quantity": {"$gt": 20}}), c.count_documents({}, skip=10, limit=100), c.estimated_document_count(), c.find({"l_linenumber": 2}).count())], "a bigint, b bigint, c bigint, d bigint"), "SELECT (SELECT count(*) FROM lineitem WHERE l_quantity > 20) AS a, CAST(100 AS BIGINT) AS b, (SELECT count(*) FROM lineitem) AS c, (SELECT count(*) FROM lineitem WHERE l_linenumber = 2) AS d")
collection("bulk_write", "nation", _then(lambda c: c.bulk_write([UpdateMany({"n_regionkey": 0}, {"$set": {"n_name": "zero"}}), DeleteOne({"n_nationkey": 1}), InsertOne({"n_nationkey": 50, "n_name": "fifty", "n_regionkey": 1}), UpdateOne({"n_nationkey": 50}, {"$inc": {"n_regionkey": 2}}), ReplaceOne({"n_nationkey": 2}, {"n_nationkey": 2, "n_name": "two"})]), lambda c: c.database.load(c.name, c.find({}, {"_id": 0}).df)), "SELECT n_nationkey, CASE WHEN n_nationkey = 2 THEN 'two' WHEN n_regionkey = 0 THEN 'zero' ELSE n_name END AS n_name, CASE WHEN n_nationkey <> 2 THEN n_regionkey END AS n_regionkey FROM nation WHERE n_nationkey <> 1 UNION ALL SELECT 50, 'fifty', 3")
collection("insert_many", "region", _then(lambda c: c.insert_many([{"r_regionkey": 7, "r_name": "seven"}, {"r_regionkey": 8, "more": 1.5}]), lambda c: c.insert_one({"r_name": "none"}), lambda c: c.database.load(c.name, c.find({}, {"_id": 0}).df)), "SELECT r_regionkey, r_name, CAST(NULL AS DOUBLE) AS more FROM region UNION ALL VALUES (7, 'seven', NULL), (8, NULL, 1.5), (NULL, 'none', NULL)")


def _refused(c, *calls) -> int:
    n = 0
    for call in calls:
        try:
            call()
        except (DuplicateKeyError, BulkWriteError):
            n += 1
    return n


collection("unique_index", "nation", lambda c: (c.create_index("n_name", unique=True), _rows(c, [(_refused(c, lambda: c.insert_one({"n_name": "NATION_3"}), lambda: c.insert_one({"n_name": "fresh"}), lambda: c.update_one({"n_nationkey": 1}, {"$set": {"n_name": "NATION_2"}}), lambda: c.create_index("n_regionkey", unique=True)), c.count_documents({}), len(c.index_information()))], "refused int, n bigint, indexes int"))[1], "SELECT 3 AS refused, count(*) + 1 AS n, 2 AS indexes FROM nation")
collection("out", "orders", lambda c: (list(c.aggregate([{"$match": {"o_orderstatus": "F"}}, {"$project": {"o_orderkey": 1}}, {"$out": "kept"}])), c.database["kept"].find().df)[1], "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
collection("rename", "region", lambda c: (c.rename("moved"), c.database["moved"].find({"r_regionkey": {"$gte": 2}}).df)[1], "SELECT r_regionkey, r_name FROM region WHERE r_regionkey >= 2")
collection("cursor_slice", "orders", lambda c: c.find({}, ["o_orderkey"]).sort("o_orderkey")[5:25].df, "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 5")
collection("map_reduce_inline", "orders", lambda c: _rows(c, [(r["_id"], r["value"]) for r in c.inline_map_reduce(lambda d: [(d["o_orderstatus"], 1)], lambda k, v: sum(v), value="bigint")], "_id string, value bigint"), "SELECT o_orderstatus AS _id, count(*) AS value FROM orders GROUP BY 1")
collection("expiry_kept", "events", lambda c: (c.create_index("ts", expireAfterSeconds=-int((datetime.datetime(2024, 1, 2) - datetime.datetime(2000, 1, 1)).total_seconds())), c.find({}, ["event_id"]).df)[1], "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-02'")
