"""Fields of mixed types, missing fields against nulls, and the order of all values."""

import datetime

import pytest

from nestwright.errors import OperationFailure
from nestwright.functions.mixed import encoded
from nestwright.sources.collections import Client

DAY = datetime.datetime(2020, 5, 17, 1, 2, 3, 4000)
VALUES = [None, -1, 2.5, 3, "a", "b", {"x": 1}, [1, "two"], b"raw", False, True, DAY]


@pytest.fixture(scope="module")
def mixed(spark):
    c = Client(spark, schemaless=True)["d"]["c"]
    c.insert_many([{"_id": i, "v": v} for i, v in enumerate(VALUES)] + [{"_id": 50, "other": 1}])
    return c


def ids(docs):
    return [d["_id"] for d in docs]


def test_encoding():
    deep = {"b": [1, {"a": None, "é": "x" * 300}], "a": {}, "": [[], [DAY]]}
    for v in [*VALUES, deep, 2**40, -(2**62), [], 1e300, datetime.date(1969, 12, 31), datetime.datetime(1960, 1, 1)]:
        assert encoded(v).toPython() == v


def test_values_come_back(mixed):
    got = {d["_id"]: d for d in mixed.find()}
    assert [got[i]["v"] for i in range(len(VALUES))] == VALUES
    assert got[50] == {"_id": 50, "other": 1} and "other" not in got[0]


@pytest.mark.parametrize(
    ("test", "want"),
    [
        ({"v": None}, [0, 50]), ({"v": {"$exists": True}}, list(range(12))), ({"v": {"$exists": False}}, [50]), ({"v": {"$type": "null"}}, [0]), ({"v": {"$ne": None}}, list(range(1, 12))),
        ({"v": 3}, [3]), ({"v": 1}, [7, 10]), ({"v": "a"}, [4]), ({"v": {"x": 1}}, [6]), ({"v": [1, "two"]}, [7]), ({"v": "two"}, [7]), ({"v.x": 1}, [6]), ({"v.1": "two"}, [7]), ({"v": DAY}, [11]), ({"v": b"raw"}, [8]),
        ({"v": {"$gt": 0}}, [2, 3, 7]), ({"v": {"$lt": 0}}, [1]), ({"v": {"$gte": "a"}}, [4, 5, 7]), ({"v": {"$gt": "a"}}, [5, 7]), ({"v": {"$lte": DAY}}, [11]),
        ({"v": {"$in": [3, "b", None]}}, [0, 3, 5, 50]), ({"v": {"$nin": [3, "b", None]}}, [1, 2, 4, 6, 7, 8, 9, 10, 11]), ({"v": {"$not": {"$gt": 0}}}, [0, 1, 4, 5, 6, 8, 9, 10, 11, 50]),
        ({"v": {"$type": "string"}}, [4, 5, 7]), ({"v": {"$type": "number"}}, [1, 2, 3, 7]), ({"v": {"$type": ["object", "bool"]}}, [6, 9, 10]), ({"v": {"$type": "int"}}, [1, 3, 7]),
        ({"v": {"$size": 2}}, [7]), ({"v": {"$all": [1, "two"]}}, [7]), ({"v": {"$elemMatch": {"$gt": 0}}}, [7]), ({"v": {"$regex": "^[at]"}}, [4, 7]), ({"$expr": {"$gt": ["$v", 2]}}, [2, 3, 4, 5, 6, 7, 8, 9, 10, 11]), ({"$expr": "$v"}, [1, 2, 3, 4, 5, 6, 7, 8, 10, 11]),
        ({"$or": [{"v": {"$lt": 0}}, {"other": 1}]}, [1, 50]), ({"$nor": [{"v": {"$type": "number"}}, {"v": None}]}, [4, 5, 6, 8, 9, 10, 11]),
    ],
)
def test_filters(mixed, test, want):
    assert sorted(ids(mixed.find(test))) == want


def test_sort_goes_by_type_first(mixed):
    assert ids(mixed.find().sort("v", 1)) == [0, 50, 1, 7, 2, 3, 4, 5, 6, 8, 9, 10, 11]  # an array by its first element
    assert ids(mixed.find().sort([("v", -1), ("_id", -1)]))[-2:] == [50, 0]
    assert ids(mixed.aggregate([{"$sort": {"v": -1}}, {"$limit": 3}])) == [11, 10, 9]


def test_groups(mixed):
    rows = [{"_id": i, "k": k, "n": n} for i, (k, n) in enumerate([(1, 2), (1.0, "x"), ("1", 3), (None, 4.5), (True, None), ("1", "3")])] + [{"_id": 9, "n": 1}]
    c = mixed.database["g"]
    c.insert_many(rows)
    got = list(c.aggregate([{"$group": {"_id": "$k", "n": {"$sum": 1}, "s": {"$sum": "$n"}, "lo": {"$min": "$n"}, "hi": {"$max": "$n"}, "all": {"$push": "$n"}, "set": {"$addToSet": "$n"}, "first": {"$first": "$n"}}}]))
    assert [d["_id"] for d in got] == [None, 1, "1", True]
    assert [d["n"] for d in got] == [2, 2, 2, 1]
    assert [d["s"] for d in got] == [5.5, 2, 3, 0]
    assert [(d.get("lo"), d.get("hi")) for d in got] == [(1, 4.5), (2, "x"), (3, "3"), (None, None)]
    assert got[1]["all"] == [2, "x"] and got[1]["set"] == [2, "x"] and got[2]["first"] == 3
    assert list(c.aggregate([{"$group": {"_id": {"k": "$k"}, "n": {"$sum": 1}}}, {"$match": {"n": 2}}, {"$count": "c"}])) == [{"c": 3}]
    assert sorted(map(str, c.distinct("k"))) == ["1", "1", "None", "True"]


def test_expressions(mixed):
    got = {d["_id"]: d for d in mixed.aggregate([{"$project": {"number": {"$isNumber": "$v"}, "array": {"$isArray": "$v"}, "either": {"$ifNull": ["$v", "none"]}, "branch": {"$cond": [{"$isNumber": "$v"}, {"$add": [{"$cond": [{"$isNumber": "$v"}, "$v", 0]}, 1]}, "text"]}, "x": "$v.x", "less": {"$lt": ["$v", 3]}}}])}
    assert [got[i]["number"] for i in range(12)] == [i in (1, 2, 3) for i in range(12)]
    assert got[7]["array"] and not got[6]["array"]
    assert got[0]["either"] == got[50]["either"] == "none" and got[3]["either"] == 3
    assert got[3]["branch"] == 4 and got[4]["branch"] == "text"
    assert got[6]["x"] == 1 and "x" not in got[3]
    assert [got[i]["less"] for i in (0, 1, 3, 4)] == [True, True, False, False]
    with pytest.raises(Exception, match="must evaluate to a number"):
        list(mixed.aggregate([{"$project": {"y": {"$add": ["$v", 1]}}}]))
    assert [d["v"] for d in mixed.aggregate([{"$match": {"_id": {"$in": [7, 4, 0]}}}, {"$unwind": "$v"}])] == ["a", 1, "two"]


def test_types_that_meet_later(spark):
    c = Client(spark)["d"]["later"]
    c.insert_one({"_id": 1, "a": 1})
    c.insert_one({"_id": 2, "a": "s"})
    c.insert_one({"_id": 3, "b": 1.5})
    assert [d.get("a") for d in c.find().sort("_id")] == [1, "s", None]
    assert ids(c.find({"a": {"$exists": False}})) == [3]
    c.update_one({"_id": 3}, {"$set": {"b": [1, "x"]}})
    assert c.find_one({"_id": 3})["b"] == [1, "x"]
    assert c.update_many({}, {"$set": {"a": None}}).modified_count == 3
    assert c.update_many({}, {"$set": {"a": None}}).modified_count == 0
    with pytest.raises(NotImplementedError):
        c.update_many({}, {"$inc": {"a": 1}})
    assert c.aggregate_df([{"$project": {"z": {"$switch": {"branches": [{"case": {"$eq": ["$_id", 1]}, "then": "one"}], "default": 0}}}}]).schema["z"].dataType.simpleString() == "variant"


def test_calls(spark):
    with Client(spark) as client:
        assert client.server_info()["ok"] == 1
        c = client.shop.things
        assert c is client["shop"]["things"]
        assert c.save({"_id": 1, "n": 1}) == 1 and c.save({"_id": 1, "n": 2}) == 1
        assert c.insert([{"_id": 2, "n": 5}, {"_id": 3, "n": 7}]) == [2, 3]
        assert c.count({"n": {"$gt": 1}}) == 3
        assert c.find_and_modify({"_id": 2}, {"$inc": {"n": 1}}, new=True)["n"] == 6
        assert c.find_and_modify({"_id": 3}, remove=True)["n"] == 7
        assert c.update({"_id": 1}, {"$set": {"n": 9}})["updatedExisting"]
        view = c.with_options(read_concern="local")
        view.insert_one({"_id": 8, "n": 0})
        assert c.count() == view.count() == 3 and c.with_options() is c
        assert c.remove({"_id": 8})["n"] == 1
        c.ensure_index("n", unique=True)
        c.reindex()
        assert [i["name"] for i in c.list_indexes()] == ["_id_", "n_1"]
        for wrong in (lambda: c.find({}, bogus=1), lambda: c.group([], {}, {}, "")):
            with pytest.raises(OperationFailure):
                wrong()
        with pytest.raises(NotImplementedError):
            c.count_documents({}, collation={"locale": "fr"})
        with pytest.raises(TypeError):
            c.insert_one({"n": 1}, bogus=1)


def test_features(spark):
    from nestwright import features

    c = Client(spark)["d"]["f"]
    c.insert_one({"_id": 1})
    with pytest.raises(NotImplementedError):
        c.find({}, session=object())
    features.ignore_feature("session")
    assert ids(c.find({}, session=object())) == [1]
    features.warn_on_feature("session")
    with pytest.raises(NotImplementedError):
        c.find({}, session=object())
    with pytest.raises(KeyError):
        features.ignore_feature("nothing")


def test_order_of_all_kinds(spark):
    """Empty arrays, then null and missing, numbers, texts, objects, arrays in arrays, bytes, truth values and times; other
    arrays by their first element."""
    c = Client(spark, schemaless=True)["d"]["order"]
    kinds = [("bool", True), ("date", DAY), ("object", {"a": 1}), ("empty", []), ("int", 1), ("nested", [[1, 2], [3, 4]]), ("null", None), ("numbers", [1, 2]), ("text", "a"), ("bytes", b"a"), ("more", 7.5)]
    c.insert_many([{"kind": k, "a": v} for k, v in kinds] + [{"kind": "missing"}])
    up = [d["kind"] for d in c.find({}, sort=[("a", 1), ("kind", 1)])]
    assert up == ["empty", "missing", "null", "int", "numbers", "more", "text", "object", "nested", "bytes", "bool", "date"]
    assert [d["kind"] for d in c.find({}, sort=[("a", -1), ("kind", -1)])] == up[::-1]


def test_sums_over_mixed_data(spark):
    c = Client(spark)["d"]["sums"]
    c.insert_many([{"g": "x"}, {"g": "x"}, {"g": "x", "d": None}, {"g": "x", "d": 0}, {"g": "x", "d": 5}, {"g": "x", "d": {"a": 1}}, {"g": "x", "d": [1]}, {"g": "x", "d": [7, 8]}])
    got = list(c.aggregate([{"$group": {"_id": "$g", "n": {"$sum": 1}, "truthy": {"$sum": {"$cond": ["$d", 1, 0]}}, "there": {"$sum": {"$cond": {"if": {"$gt": ["$d", None]}, "then": 1, "else": 0}}}, "sum": {"$sum": "$d"}}}]))
    assert got == [{"_id": "x", "n": 8, "truthy": 4, "there": 5, "sum": 5}]


def test_missing_group_key_is_null(spark):
    for schemaless in (False, True):
        c = Client(spark, schemaless=schemaless)["d"]["keys"]
        c.insert_many([{"a": 1}, {}, {"a": None}])
        assert [d["_id"] for d in c.aggregate([{"$group": {"_id": "$a"}}])] == [None, 1]


def test_unwind_of_mixed_sizes(spark):
    c = Client(spark)["d"]["sizes"]
    c.insert_many([{"_id": 1, "s": ["S", "M"]}, {"_id": 2, "s": []}, {"_id": 3, "s": "L"}, {"_id": 4}, {"_id": 5, "s": None}, {"_id": 6, "s": False}])
    assert list(c.aggregate([{"$unwind": {"path": "$s", "includeArrayIndex": "i"}}])) == [{"_id": 1, "s": "S", "i": 0}, {"_id": 1, "s": "M", "i": 1}, {"_id": 3, "s": "L", "i": None}, {"_id": 6, "s": False, "i": None}]
    assert list(c.aggregate([{"$unwind": {"path": "$s", "preserveNullAndEmptyArrays": True}}])) == [{"_id": 1, "s": "S"}, {"_id": 1, "s": "M"}, {"_id": 2}, {"_id": 3, "s": "L"}, {"_id": 4}, {"_id": 5, "s": None}, {"_id": 6, "s": False}]
