"""Queries of the engine's own operators with the SQL that says the same."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestwright.plans.pipeline import run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(table: str, pipeline: list, finish=None):
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = run(_table(spark, sf_dir, table), pipeline, lambda name: _table(spark, sf_dir, name))
        return finish(df) if finish else df

    return call


def _match(filter_: dict, table: str = "lineitem", keep: tuple = ("l_orderkey", "l_linenumber")) -> list:
    return [{"$match": filter_}, {"$project": dict.fromkeys(keep, 1)}]


_CUT = datetime.datetime(2000, 1, 1)
QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, table: str, pipeline: list, sql: str, finish=None) -> None:
    QUERIES[name] = _query(table, pipeline, finish)
    SQL[name] = sql


def _flat(*names: str):
    """Members of _id as columns."""
    return lambda df: df.select(*(F.col(f"_id.{n}").alias(n) for n in names), *(c for c in df.columns if c != "_id"))


def _rounded(*names: str):
    return lambda df: df.withColumns({n: F.round(n, 4) for n in names})


add(
    "pipeline_pricing_summary", "lineitem",
    [{"$match": {"l_shipdate": {"$lte": _CUT}}}, {"$group": {"_id": {"flag": "$l_returnflag", "status": "$l_linestatus"}, "sum_qty": {"$sum": "$l_quantity"}, "avg_price": {"$avg": "$l_extendedprice"}, "n": {"$sum": 1}}}, {"$sort": {"_id": 1}}],
    "SELECT l_returnflag AS flag, l_linestatus AS status, round(sum(l_quantity),4) AS sum_qty, round(avg(l_extendedprice),4) AS avg_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-01-01' GROUP BY ALL",
    lambda df: _rounded("sum_qty", "avg_price")(_flat("flag", "status")(df)),
)

# Filters ------------------------------------------------------------------------------------------
for _name, _spec, _where in (
    ("eq", {"l_returnflag": "A"}, "l_returnflag = 'A'"),
    ("eq_operator", {"l_linenumber": {"$eq": 3}}, "l_linenumber = 3"),
    ("ne", {"l_returnflag": {"$ne": "A"}}, "l_returnflag IS DISTINCT FROM 'A'"),
    ("gt", {"l_quantity": {"$gt": 45}}, "l_quantity > 45"),
    ("gte", {"l_quantity": {"$gte": 45}}, "l_quantity >= 45"),
    ("lt", {"l_quantity": {"$lt": 5}}, "l_quantity < 5"),
    ("lte_date", {"l_shipdate": {"$lte": datetime.datetime(1996, 1, 1)}}, "l_shipdate <= TIMESTAMP '1996-01-01'"),
    ("type_bracket", {"$or": [{"l_quantity": {"$gt": "a"}}, {"l_returnflag": {"$lt": 5}}, {"l_quantity": {"$gt": 48}}]}, "l_quantity > 48"),
    ("in", {"l_linenumber": {"$in": [1, 7]}}, "l_linenumber IN (1, 7)"),
    ("in_null", {"l_linenumber": {"$in": [1, None]}}, "l_linenumber = 1 OR l_linenumber IS NULL"),
    ("nin", {"l_linenumber": {"$nin": [1, 2, 3]}}, "l_linenumber NOT IN (1, 2, 3)"),
    ("and", {"$and": [{"l_quantity": {"$gt": 10}}, {"l_discount": {"$lt": 0.03}}]}, "l_quantity > 10 AND l_discount < 0.03"),
    ("or", {"$or": [{"l_quantity": 1}, {"l_tax": {"$gte": 0.08}}]}, "l_quantity = 1 OR l_tax >= 0.08"),
    ("nor", {"$nor": [{"l_quantity": {"$gt": 5}}, {"l_returnflag": "R"}]}, "NOT (l_quantity > 5 OR l_returnflag = 'R')"),
    ("not", {"l_quantity": {"$not": {"$gt": 5}}}, "NOT l_quantity > 5"),
    ("exists", {"l_tax": {"$exists": True}, "nowhere": {"$exists": False}, "l_linenumber": 4}, "l_linenumber = 4"),
    ("exists_not", {"$or": [{"nowhere": {"$exists": True}}, {"l_tax": {"$exists": False}}, {"l_linenumber": 6}]}, "l_linenumber = 6"),
    ("missing_is_null", {"nowhere": None, "l_linenumber": 2}, "l_linenumber = 2"),
    ("lte", {"l_quantity": {"$lte": 4}}, "l_quantity <= 4"),
    ("comment", {"$comment": "said, not tested", "l_linenumber": 1}, "l_linenumber = 1"),
    ("regex_literal", {"l_linestatus": re.compile("^o", re.I)}, "regexp_matches(l_linestatus, '^o', 'i')"),
    ("regex", {"l_returnflag": {"$regex": "^[an]", "$options": "i"}}, "regexp_matches(l_returnflag, '^[an]', 'i')"),
    ("expr", {"$expr": {"$gt": [{"$multiply": ["$l_quantity", "$l_discount"]}, 4]}}, "l_quantity * l_discount > 4"),
    ("range", {"l_quantity": {"$gte": 10, "$lt": 12}}, "l_quantity >= 10 AND l_quantity < 12"),
):
    add(f"match_{_name}", "lineitem", _match(_spec), f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {_where}")

for _name, _spec, _where in (
    ("all", {"words": {"$all": ["small", "ring"]}}, "list_contains(words, 'small') AND list_contains(words, 'ring')"),
    ("element", {"words": "ring"}, "list_contains(words, 'ring')"),
    ("whole", {"words": ["small", "ring"]}, "words = ['small', 'ring']"),
    ("size", {"words": {"$size": 2}}, "len(words) = 2"),
    ("elemmatch", {"words": {"$elemMatch": {"$gte": "s", "$lt": "t"}}}, "len(list_filter(words, lambda w: w >= 's' AND w < 't')) > 0"),
    ("ne", {"words": {"$ne": "ring"}}, "NOT list_contains(words, 'ring')"),
):
    add(f"array_{_name}", "part", [{"$addFields": {"words": {"$split": ["$p_name", " "]}}}, {"$match": _spec}, {"$project": {"p_partkey": 1}}], f"SELECT p_partkey FROM (SELECT *, string_split(p_name, ' ') AS words FROM part) WHERE {_where}")

# Shapes -------------------------------------------------------------------------------------------
add("project_include", "nation", [{"$project": {"n_name": 1, "n_regionkey": True}}], "SELECT n_name, n_regionkey FROM nation")
add("project_exclude", "nation", [{"$project": {"n_regionkey": 0}}], "SELECT n_nationkey, n_name FROM nation")
add("project_computed", "supplier", [{"$project": {"s_suppkey": 1, "k": {"$add": ["$s_suppkey", 5]}, "gone": "$nowhere", "label": {"$literal": "$x"}}}], "SELECT s_suppkey, s_suppkey + 5 AS k, '$x' AS label FROM supplier")
add("project_nested", "nation", [{"$project": {"o": {"name": "$n_name", "key": "$n_nationkey"}}}, {"$project": {"o.name": 1}}, {"$project": {"name": "$o.name"}}], "SELECT n_name AS name FROM nation")
add("addfields", "nation", [{"$addFields": {"twice": {"$multiply": ["$n_nationkey", 2]}, "n_regionkey": "$n_nationkey"}}], "SELECT n_nationkey, n_name, n_nationkey AS n_regionkey, n_nationkey * 2 AS twice FROM nation")
add("set_nested", "nation", [{"$set": {"a.b": "$n_name"}}, {"$set": {"a.c": "$n_nationkey"}}, {"$project": {"b": "$a.b", "c": "$a.c"}}], "SELECT n_name AS b, n_nationkey AS c FROM nation")
add("sort_limit_topk", "orders", [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$limit": 20}, {"$project": {"o_orderkey": 1, "o_totalprice": 1}}], "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
add("skip_limit", "orders", [{"$sort": {"o_orderkey": 1}}, {"$skip": 30}, {"$limit": 10}, {"$project": {"o_orderkey": 1}}], "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 30")
add("count", "orders", [{"$match": {"o_orderstatus": "F"}}, {"$count": "n"}], "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
add("replaceroot", "nation", [{"$replaceRoot": {"newRoot": {"k": "$n_nationkey", "v": "$n_name"}}}], "SELECT n_nationkey AS k, n_name AS v FROM nation")
add("sample_size", "orders", [{"$match": {"o_orderstatus": "F"}}, {"$sample": {"size": 25}}, {"$group": {"_id": "$o_orderstatus", "n": {"$sum": 1}, "keys": {"$addToSet": "$o_orderkey"}}}, {"$project": {"_id": 1, "n": 1, "distinct": {"$size": "$keys"}}}], "SELECT o_orderstatus AS _id, least(count(*), 25) AS n, CAST(least(count(DISTINCT o_orderkey), 25) AS INTEGER) AS distinct FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
add("unwind", "part", [{"$project": {"p_partkey": 1, "w": {"$split": ["$p_name", " "]}}}, {"$unwind": "$w"}], "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part")
add("unwind_index", "part", [{"$project": {"p_partkey": 1, "w": {"$split": ["$p_name", " "]}}}, {"$unwind": {"path": "$w", "includeArrayIndex": "i"}}], "SELECT p_partkey, w[i + 1] AS w, i FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), unnest(range(len(w))) t(i)")
add("unwind_preserve", "part", [{"$project": {"p_partkey": 1, "w": {"$filter": {"input": {"$split": ["$p_name", " "]}, "cond": {"$eq": ["$$this", "ring"]}}}}}, {"$unwind": {"path": "$w", "preserveNullAndEmptyArrays": True}}], "SELECT p_partkey, CASE WHEN list_contains(string_split(p_name, ' '), 'ring') THEN 'ring' END AS w FROM part")

# Groups -------------------------------------------------------------------------------------------
add("group_sum_avg", "lineitem", [{"$group": {"_id": "$l_returnflag", "s": {"$sum": "$l_quantity"}, "a": {"$avg": "$l_tax"}, "n": {"$sum": 1}, "t": {"$sum": "$l_linestatus"}}}], "SELECT l_returnflag AS _id, round(sum(l_quantity),4) AS s, round(avg(l_tax),4) AS a, count(*) AS n, 0 AS t FROM lineitem GROUP BY 1", _rounded("s", "a"))
add("group_min_max", "orders", [{"$group": {"_id": "$o_orderpriority", "lo": {"$min": "$o_totalprice"}, "hi": {"$max": "$o_orderdate"}}}], "SELECT o_orderpriority AS _id, min(o_totalprice) AS lo, max(o_orderdate) AS hi FROM orders GROUP BY 1")
add("group_first_last", "orders", [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$group": {"_id": "$o_orderstatus", "first": {"$first": "$o_orderkey"}, "last": {"$last": "$o_orderkey"}}}], "SELECT o_orderstatus AS _id, first(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS first, last(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS last FROM orders GROUP BY 1")
add("group_push", "nation", [{"$sort": {"n_nationkey": -1}}, {"$group": {"_id": "$n_regionkey", "names": {"$push": "$n_name"}}}], "SELECT n_regionkey AS _id, string_agg(n_name, ',' ORDER BY n_nationkey DESC) AS names FROM nation GROUP BY 1", lambda df: df.withColumn("names", F.array_join("names", ",")))
add("group_addtoset", "nation", [{"$group": {"_id": None, "keys": {"$addToSet": "$n_regionkey"}}}], "SELECT CAST(NULL AS VARCHAR) AS _id, count(DISTINCT n_regionkey) AS n FROM nation", lambda df: df.select("_id", F.size("keys").cast("bigint").alias("n")))
add("group_null_id_empty", "nation", [{"$match": {"n_name": "none"}}, {"$group": {"_id": None, "n": {"$sum": 1}}}], "SELECT CAST(NULL AS VARCHAR) AS _id, CAST(0 AS BIGINT) AS n")
add("group_expr_id", "orders", [{"$group": {"_id": {"$year": "$o_orderdate"}, "n": {"$sum": 1}}}], "SELECT CAST(year(o_orderdate) AS INTEGER) AS _id, count(*) AS n FROM orders GROUP BY 1")
add("group_no_accumulator", "orders", [{"$group": {"_id": "$o_orderpriority"}}], "SELECT DISTINCT o_orderpriority AS _id FROM orders")
add("group_mergeobjects", "nation", [{"$project": {"n_regionkey": 1, "o": {"name": "$n_name", "key": "$n_nationkey"}}}, {"$sort": {"o.key": 1}}, {"$group": {"_id": "$n_regionkey", "m": {"$mergeObjects": "$o"}}}, {"$project": {"_id": 1, "name": "$m.name"}}], "SELECT n_regionkey AS _id, last(n_name ORDER BY n_nationkey) AS name FROM nation GROUP BY 1")
add("bucket_default", "part", [{"$bucket": {"groupBy": "$p_size", "boundaries": [0, 10, 20], "default": 99, "output": {"n": {"$sum": 1}, "p": {"$max": "$p_retailprice"}}}}], "SELECT CASE WHEN p_size < 10 THEN 0 WHEN p_size < 20 THEN 10 ELSE 99 END AS _id, count(*) AS n, max(p_retailprice) AS p FROM part GROUP BY 1")
add("bucket_count", "part", [{"$bucket": {"groupBy": "$p_size", "boundaries": [0, 25, 1000]}}], "SELECT CASE WHEN p_size < 25 THEN 0 ELSE 25 END AS _id, count(*) AS count FROM part GROUP BY 1")
add("facet", "orders", [{"$facet": {"a": [{"$match": {"o_orderstatus": "F"}}, {"$count": "n"}], "b": [{"$group": {"_id": "$o_orderpriority"}}]}}], "SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS a, (SELECT count(DISTINCT o_orderpriority) FROM orders) AS b", lambda df: df.select(F.get("a", F.lit(0))["n"].alias("a"), F.size("b").cast("bigint").alias("b")))

# Joins --------------------------------------------------------------------------------------------
_NATIONS = {"from": "nation", "localField": "r_regionkey", "foreignField": "n_regionkey", "as": "nations"}
add("lookup_scalar", "region", [{"$lookup": _NATIONS}, {"$project": {"r_name": 1, "nations": 1}}], "SELECT r_name, string_agg(n_name, ',' ORDER BY n_nationkey) AS nations FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY 1", lambda df: df.select("r_name", F.array_join(F.transform(F.array_sort(F.transform("nations", lambda x: F.struct(x["n_nationkey"], x["n_name"]))), lambda x: x["n_name"]), ",").alias("nations")))
add("lookup_unwind_join", "orders", [{"$lookup": {"from": "customer", "localField": "o_custkey", "foreignField": "c_custkey", "as": "c"}}, {"$unwind": "$c"}, {"$project": {"o_orderkey": 1, "name": "$c.c_name"}}], "SELECT o_orderkey, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey")
add("lookup_semi", "customer", [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}}, {"$match": {"o": {"$ne": []}}}, {"$project": {"c_custkey": 1}}], "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
add("lookup_anti", "customer", [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}}, {"$match": {"o": []}}, {"$project": {"c_custkey": 1}}], "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
add("lookup_anti_orders", "orders", [{"$lookup": {"from": "customer", "localField": "o_orderkey", "foreignField": "c_custkey", "as": "c"}}, {"$match": {"c": {"$size": 0}}}, {"$project": {"o_orderkey": 1, "o_custkey": 1}}], "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer)")
add("lookup_count", "customer", [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}}, {"$project": {"c_custkey": 1, "n": {"$size": "$o"}}}], "SELECT c_custkey, CAST(count(o_orderkey) AS INTEGER) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
add("graphlookup", "nation", [{"$graphLookup": {"from": "nation", "startWith": "$n_regionkey", "connectFromField": "n_regionkey", "connectToField": "n_nationkey", "as": "up", "depthField": "d", "maxDepth": 3}}, {"$project": {"n_nationkey": 1, "n": {"$size": "$up"}}}], "WITH RECURSIVE r AS (SELECT a.n_nationkey AS s, b.n_nationkey AS k, b.n_regionkey AS up, 0 AS d FROM nation a JOIN nation b ON b.n_nationkey = a.n_regionkey UNION SELECT s, n_nationkey, n_regionkey, d + 1 FROM r JOIN nation ON n_nationkey = up WHERE d < 3) SELECT n_nationkey, CAST(count(DISTINCT k) AS INTEGER) AS n FROM nation LEFT JOIN r ON s = n_nationkey GROUP BY 1")

# Expressions --------------------------------------------------------------------------------------
_O, _L, _P = ("orders", "o_orderkey"), ("lineitem", "l_orderkey"), ("part", "p_partkey")
for _name, (_t, _key), _e, _sql in (
    ("abs", _L, {"$abs": {"$subtract": ["$l_tax", "$l_discount"]}}, "round(abs(l_tax - l_discount), 4)"),
    ("ceil", _L, {"$ceil": "$l_discount"}, "CAST(ceil(l_discount) AS BIGINT)"),
    ("floor", _O, {"$floor": "$o_totalprice"}, "CAST(floor(o_totalprice) AS BIGINT)"),
    ("trunc", _O, {"$trunc": "$o_totalprice"}, "CAST(trunc(o_totalprice) AS BIGINT)"),
    ("exp", _L, {"$exp": "$l_tax"}, "round(exp(l_tax), 4)"),
    ("ln", _L, {"$ln": "$l_quantity"}, "round(ln(l_quantity), 4)"),
    ("log10", _L, {"$log10": "$l_quantity"}, "round(log10(l_quantity), 4)"),
    ("log", _L, {"$log": ["$l_quantity", 2]}, "round(log2(l_quantity), 4)"),
    ("sqrt", _L, {"$sqrt": "$l_quantity"}, "round(sqrt(l_quantity), 4)"),
    ("pow", _L, {"$pow": ["$l_quantity", 2]}, "round(pow(l_quantity, 2), 4)"),
    ("divide", _L, {"$divide": ["$l_extendedprice", "$l_quantity"]}, "l_extendedprice / l_quantity"),
    ("mod", _L, {"$mod": ["$l_orderkey", 7]}, "CAST(l_orderkey % 7 AS DOUBLE)"),
    ("add_overflow", _L, {"$add": [2147483647, "$l_linenumber"]}, "2147483647 + CAST(l_linenumber AS BIGINT)"),
    ("multiply_overflow", _L, {"$multiply": ["$l_linenumber", 2147483647]}, "2147483647 * CAST(l_linenumber AS BIGINT)"),
    ("subtract_overflow", _L, {"$subtract": [{"$subtract": [0, 2147483647]}, "$l_linenumber"]}, "-2147483647 - CAST(l_linenumber AS BIGINT)"),
    ("subtract_dates", _O, {"$subtract": ["$o_orderdate", datetime.datetime(1995, 1, 1)]}, "date_diff('millisecond', TIMESTAMP '1995-01-01', o_orderdate)"),
    ("sum_list", _L, {"$sum": ["$l_tax", "$l_discount", "$l_returnflag"]}, "round(l_tax + l_discount, 4)"),
    ("avg_list", _L, {"$avg": ["$l_tax", "$l_discount"]}, "round((l_tax + l_discount) / 2, 4)"),
    ("max_list", _L, {"$max": ["$l_tax", "$l_discount"]}, "greatest(l_tax, l_discount)"),
    ("min_list", _L, {"$min": ["$l_tax", "$l_discount"]}, "least(l_tax, l_discount)"),
    ("eq", _O, {"$eq": ["$o_orderstatus", "F"]}, "o_orderstatus = 'F'"),
    ("gt_cross_type", _O, {"$and": [{"$gt": ["$o_orderstatus", "$o_totalprice"]}, {"$gt": ["$o_totalprice", 1e5]}]}, "o_totalprice > 100000"),
    ("ne", _O, {"$ne": ["$o_orderstatus", "F"]}, "o_orderstatus <> 'F'"),
    ("gte", _O, {"$gte": ["$o_totalprice", 1e5]}, "o_totalprice >= 100000"),
    ("lt", _O, {"$lt": ["$o_totalprice", 1e5]}, "o_totalprice < 100000"),
    ("lte", _O, {"$lte": ["$o_orderstatus", "O"]}, "o_orderstatus <= 'O'"),
    ("and", _L, {"$and": [{"$gt": ["$l_tax", 0.04]}, "$l_quantity"]}, "l_tax > 0.04"),
    ("or", _L, {"$or": [{"$gt": ["$l_tax", 0.04]}, "$nowhere"]}, "l_tax > 0.04"),
    ("not", _L, {"$not": {"$gt": ["$l_tax", 0.04]}}, "NOT l_tax > 0.04"),
    ("cond", _O, {"$cond": [{"$gte": ["$o_totalprice", 100000]}, "big", "small"]}, "CASE WHEN o_totalprice >= 100000 THEN 'big' ELSE 'small' END"),
    ("ifnull", _O, {"$ifNull": ["$nowhere", "$o_orderstatus"]}, "o_orderstatus"),
    ("switch", _O, {"$switch": {"branches": [{"case": {"$eq": ["$o_orderstatus", "F"]}, "then": 1}, {"case": {"$eq": ["$o_orderstatus", "O"]}, "then": 2}], "default": 3}}, "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END"),
    ("let", _L, {"$let": {"vars": {"q": "$l_quantity"}, "in": {"$multiply": ["$$q", "$$q"]}}}, "l_quantity * l_quantity"),
    ("lower", _O, {"$toLower": "$o_orderpriority"}, "lower(o_orderpriority)"),
    ("upper", _P, {"$toUpper": "$p_name"}, "upper(p_name)"),
    ("concat", _P, {"$concat": ["$p_name", "/", "$p_type"]}, "p_name || '/' || p_type"),
    ("substr", _P, {"$substr": ["$p_name", 2, 4]}, "substr(p_name, 3, 4)"),
    ("strcasecmp", _P, {"$strcasecmp": ["$p_name", "m"]}, "CASE WHEN p_name = 'm' THEN 0 WHEN p_name < 'm' THEN -1 ELSE 1 END"),
    ("regexmatch", _P, {"$regexMatch": {"input": "$p_name", "regex": "RING$", "options": "i"}}, "regexp_matches(p_name, 'RING$', 'i')"),
    ("year", _O, {"$year": "$o_orderdate"}, "CAST(year(o_orderdate) AS INTEGER)"),
    ("month", _O, {"$month": "$o_orderdate"}, "CAST(month(o_orderdate) AS INTEGER)"),
    ("dayofmonth", _O, {"$dayOfMonth": "$o_orderdate"}, "CAST(day(o_orderdate) AS INTEGER)"),
    ("dayofyear", _O, {"$dayOfYear": "$o_orderdate"}, "CAST(dayofyear(o_orderdate) AS INTEGER)"),
    ("dayofweek", _O, {"$dayOfWeek": "$o_orderdate"}, "CAST(dayofweek(o_orderdate) + 1 AS INTEGER)"),
    ("week", _O, {"$week": "$o_orderdate"}, "CAST(strftime(o_orderdate, '%U') AS INTEGER)"),
    ("datetostring", _O, {"$dateToString": {"format": "%Y-%m/%d", "date": "$o_orderdate"}}, "strftime(o_orderdate, '%Y-%m/%d')"),
    ("datefromparts", _O, {"$dateFromParts": {"year": {"$year": "$o_orderdate"}, "month": 2}}, "make_timestamp(year(o_orderdate), 2, 1, 0, 0, 0)"),
    ("arrayelemat", _P, {"$arrayElemAt": [{"$split": ["$p_name", " "]}, -1]}, "string_split(p_name, ' ')[-1]"),
    ("size", _P, {"$size": {"$split": ["$p_name", " "]}}, "CAST(len(string_split(p_name, ' ')) AS INTEGER)"),
    ("in", _P, {"$in": ["ring", {"$split": ["$p_name", " "]}]}, "list_contains(string_split(p_name, ' '), 'ring')"),
    ("setequals", _P, {"$setEquals": [{"$split": ["$p_name", " "]}, {"$split": ["ring small", " "]}]}, "list_sort(list_distinct(string_split(p_name, ' '))) = ['ring', 'small']"),
    ("tostring", _P, {"$toString": "$p_size"}, "CAST(p_size AS VARCHAR)"),
    ("toint", _P, {"$toInt": "$p_retailprice"}, "CAST(trunc(p_retailprice) AS INTEGER)"),
    ("tolong", _P, {"$toLong": {"$toString": "$p_size"}}, "CAST(p_size AS BIGINT)"),
    ("todecimal", _P, {"$toString": {"$toDecimal": "$p_size"}}, "CAST(CAST(p_size AS DECIMAL(38, 14)) AS VARCHAR)"),
    ("first", _P, {"$first": {"$split": ["$p_name", " "]}}, "string_split(p_name, ' ')[1]"),
    ("last", _P, {"$last": {"$split": ["$p_name", " "]}}, "string_split(p_name, ' ')[-1]"),
    ("objecttoarray_values", _P, {"$let": {"vars": {"o": {"$objectToArray": {"a": "$p_name", "b": "$p_type"}}}, "in": {"$arrayElemAt": [{"$map": {"input": "$$o", "in": {"$concat": ["$$this.k", "=", "$$this.v"]}}}, 1]}}}, "'b=' || p_type"),
    ("arraytoobject", _P, {"$let": {"vars": {"o": {"$arrayToObject": {"$objectToArray": {"a": "$p_name", "b": "$p_type"}}}}, "in": "$$o.b"}}, "p_type"),
    ("let_nested", _P, {"$let": {"vars": {"x": "$p_size"}, "in": {"$let": {"vars": {"y": {"$add": ["$$x", 1]}}, "in": {"$multiply": ["$$x", "$$y"]}}}}}, "CAST(p_size AS BIGINT) * (p_size + 1)"),
    ("root", _P, {"$concat": ["$$ROOT.p_name", "$$CURRENT.p_type"]}, "p_name || p_type"),
):
    _round = _sql.startswith("round(")
    add(f"expr_{_name}", _t, [{"$project": {_key: 1, "x": _e}}], f"SELECT {_key}, {_sql} AS x FROM {_t}", _rounded("x") if _round else None)

for _name, _e, _sql in (
    ("map", {"$map": {"input": "$w", "as": "s", "in": {"$toUpper": "$$s"}}}, "list_transform(w, lambda s: upper(s))"),
    ("filter", {"$filter": {"input": "$w", "cond": {"$gt": ["$$this", "m"]}}}, "list_filter(w, lambda s: s > 'm')"),
    ("slice", {"$slice": ["$w", -1]}, "w[-1:]"),
    ("concatarrays", {"$concatArrays": ["$w", "$w"]}, "list_concat(w, w)"),
    ("setunion", {"$setUnion": ["$w", {"$split": ["ring x", " "]}]}, "list_concat(w, list_filter(['ring', 'x'], lambda s: NOT list_contains(w, s)))"),
    ("split", "$w", "w"),
):
    add(f"expr_{_name}", "part", [{"$addFields": {"w": {"$split": ["$p_name", " "]}}}, {"$project": {"p_partkey": 1, "x": _e}}], f"SELECT p_partkey, array_to_string({_sql}, ',') AS x FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)", lambda df: df.withColumn("x", F.array_join("x", ",")))


# Collections --------------------------------------------------------------------------------------
def collection(name: str, table: str, call, sql: str) -> None:
    """A query over a collection that holds a table; `call` gets the collection and returns a DataFrame."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from nestwright.sources.collections import Client

        db = Client(spark, lambda: _CUT)["tables"]
        return call(db.load(table, _table(spark, sf_dir, table)))

    QUERIES[name], SQL[name] = query, sql


def _after(change):
    """The collection's documents after a write."""

    def call(c):
        change(c)
        return c.find().df

    return call


_ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
_CUSTOMERS = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"
collection("find_filter_project", "orders", lambda c: c.find({"o_totalprice": {"$gt": 100000}}, ["o_orderkey", "o_totalprice"]).df, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
collection("find_exclude", "orders", lambda c: c.find({"o_orderstatus": "F"}, {"o_orderdate": 0, "o_orderpriority": 0}).df, "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
collection("find_sort_skip_limit", "orders", lambda c: c.find({}, ["o_orderkey", "o_custkey"]).sort([("o_custkey", -1), ("o_orderkey", 1)]).skip(10).limit(25).df, "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey DESC, o_orderkey LIMIT 25 OFFSET 10")
collection("find_negative_limit", "orders", lambda c: c.find({}, ["o_orderkey"]).sort("o_orderkey").limit(-7).df, "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7")
collection("distinct", "lineitem", lambda c: c.distinct_df("l_shipdate", {"l_quantity": {"$lt": 20}}), "SELECT DISTINCT l_shipdate AS value FROM lineitem WHERE l_quantity < 20")
collection("distinct_array", "embeddings", lambda c: c.distinct_df("embedding", {"label": 1}), "SELECT DISTINCT unnest(embedding) AS value FROM embeddings WHERE label = 1")
collection("update_many_set_inc", "orders", _after(lambda c: c.update_many({"o_orderstatus": "O"}, {"$set": {"o_orderpriority": "none"}, "$inc": {"o_custkey": 5}})), "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_custkey + 5 ELSE o_custkey END AS o_custkey, o_orderstatus, o_totalprice, o_orderdate, CASE WHEN o_orderstatus = 'O' THEN 'none' ELSE o_orderpriority END AS o_orderpriority FROM orders")
collection("update_min_max", "customer", _after(lambda c: c.update_many({"c_nationkey": {"$lt": 12}}, {"$max": {"c_acctbal": 1000.0}, "$min": {"c_nationkey": 4}})), "SELECT c_custkey, c_name, CASE WHEN c_nationkey < 12 THEN least(c_nationkey, 4) ELSE c_nationkey END AS c_nationkey, CASE WHEN c_nationkey < 12 THEN greatest(c_acctbal, 1000) ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
collection("update_unset_rename", "customer", _after(lambda c: c.update_many({"c_acctbal": {"$lt": 0}}, {"$unset": {"c_name": ""}, "$rename": {"c_mktsegment": "segment"}})), "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name END AS c_name, c_nationkey, c_acctbal, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_acctbal < 0 THEN c_mktsegment END AS segment FROM customer")
collection("update_arrays", "embeddings", lambda c: (c.update_many({"label": 2}, {"$push": {"embedding": {"$each": [0.5], "$position": 0, "$slice": 3}}}), c.update_many({"label": 3}, {"$pop": {"embedding": 1}})) and c.aggregate_df([{"$project": {"vec_id": 1, "n": {"$size": "$embedding"}}}]), "SELECT vec_id, CAST(CASE label WHEN 2 THEN 3 WHEN 3 THEN len(embedding) - 1 ELSE len(embedding) END AS INTEGER) AS n FROM embeddings")
collection("replace_one", "region", _after(lambda c: c.replace_one({"r_regionkey": 2}, {"r_name": "replaced"})), "SELECT CASE WHEN r_regionkey = 2 THEN NULL ELSE r_regionkey END AS r_regionkey, CASE WHEN r_regionkey = 2 THEN 'replaced' ELSE r_name END AS r_name FROM region")
collection("delete_many", "orders", _after(lambda c: c.delete_many({"o_orderdate": {"$lt": datetime.datetime(1997, 1, 1)}})), f"SELECT {_ORDERS} FROM orders WHERE NOT o_orderdate < TIMESTAMP '1997-01-01'")
collection("insert_df", "customer", _after(lambda c: c.insert_df(c.find({"c_nationkey": 3}).df)), f"SELECT {_CUSTOMERS} FROM customer UNION ALL SELECT {_CUSTOMERS} FROM customer WHERE c_nationkey = 3")
collection("expiry", "events", lambda c: (c.create_index("ts", expireAfterSeconds=0), c.find({}, ["event_id"]).df)[1], "SELECT event_id FROM events WHERE NOT ts <= TIMESTAMP '2000-01-01'")
collection("map_reduce", "lineitem", lambda c: c.map_reduce(lambda d: [(d["l_returnflag"], d["l_linenumber"])], lambda k, v: sum(v), "sums", "bigint").find().df, "SELECT l_returnflag AS _id, CAST(sum(l_linenumber) AS BIGINT) AS value FROM lineitem GROUP BY 1")

from nestwright.plans import edge_queries  # noqa: E402, F401  registers its own
