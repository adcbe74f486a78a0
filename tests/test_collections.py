"""Collections: reads, writes, constraints, expiry and map-reduce."""

import datetime

import pytest

from nestwright.errors import BulkWriteError, CollectionInvalid, DuplicateKeyError, InvalidOperation, OperationFailure, WriteError
from nestwright.sources.collections import AFTER, Client
from nestwright.sources.results import DeleteMany, InsertOne, ReplaceOne, UpdateMany, UpdateOne

NOW = datetime.datetime(2024, 5, 1, 12)


@pytest.fixture
def db(spark):
    return Client(spark, lambda: NOW)["db"]


@pytest.fixture
def docs(db):
    c = db["docs"]
    c.insert_many([
        {"_id": 1, "a": 1, "tags": ["x", "y"], "o": {"p": 1, "q": "u"}, "l": [{"k": 1, "n": 5}, {"k": 2, "n": 7}]},
        {"_id": 2, "a": 2, "tags": [], "o": {"p": 2, "q": None}, "l": [{"k": 2, "n": 9}]},
        {"_id": 3, "a": 3, "tags": None, "o": None, "l": []},
        {"_id": 4, "a": 3, "tags": ["y", "y", "z"], "o": {"p": 4, "q": "v"}, "l": None},
    ])
    return c


def ids(cursor):
    return [d["_id"] for d in cursor]


def test_find(docs):
    assert ids(docs.find()) == [1, 2, 3, 4]
    assert ids(docs.find({"a": 3})) == [3, 4]
    assert ids(docs.find().sort("a", -1)) == [3, 4, 2, 1]
    assert ids(docs.find().sort([("a", -1), ("_id", -1)]).skip(1).limit(2)) == [3, 2]
    assert ids(docs.find().limit(-2)) == [1, 2]
    assert ids(docs.find()[1:3]) == [2, 3]
    assert docs.find()[2]["_id"] == 3
    assert docs.find_one(4)["tags"] == ["y", "y", "z"]
    assert docs.find_one({"_id": 99}) is None
    with pytest.raises(ValueError):
        docs.find().sort([])


def test_cursor_state(docs):
    with docs.find() as c:
        assert next(c)["_id"] == 1
        with pytest.raises(InvalidOperation):
            c.sort("a")
        assert ids(c.clone()) == [1, 2, 3, 4]
        assert ids(c.rewind()) == [1, 2, 3, 4]
        assert not c.alive
    with pytest.raises(TypeError):
        docs.find().batch_size("many")


def test_projection(docs):
    assert docs.find_one(1, {"a": 1}) == {"_id": 1, "a": 1}
    assert docs.find_one(1, ["a"]) == {"_id": 1, "a": 1}
    assert set(docs.find_one(1, {"a": 0, "l": 0})) == {"_id", "tags", "o"}
    assert docs.find_one(1, {"_id": 0, "o.p": 1}) == {"o": {"p": 1}}
    assert docs.find_one(1, {"l.n": 1, "_id": 0}) == {"l": [{"n": 5}, {"n": 7}]}
    assert docs.find_one(4, {"tags": {"$slice": -2}})["tags"] == ["y", "z"]
    assert docs.find_one(4, {"tags": {"$slice": [1, 1]}})["tags"] == ["y"]
    assert docs.find_one(1, {"l": {"$elemMatch": {"k": 2}}})["l"] == [{"k": 2, "n": 7}]
    assert docs.find_one(2, {"l": {"$elemMatch": {"k": 1}}})["l"] is None
    with pytest.raises(ValueError):
        docs.find_one(1, {"a": 1, "l": 0})


def test_distinct_and_counts(docs):
    assert sorted(docs.distinct("a")) == [1, 2, 3]
    assert sorted(docs.distinct("tags"), key=str) == [None, "x", "y", "z"]
    assert docs.distinct("nowhere") == []
    assert docs.count_documents({}) == 4
    assert docs.count_documents({"a": 3}, skip=1) == 1
    assert docs.count_documents({}, limit=3) == 3
    with pytest.raises(OperationFailure):
        docs.count_documents({}, limit=0)


def test_insert(db):
    c = db["c"]
    assert c.insert_one({"_id": 1}).inserted_id == 1
    with pytest.raises(DuplicateKeyError):
        c.insert_one({"_id": 1})
    with pytest.raises(BulkWriteError) as e:
        c.insert_many([{"_id": 2}, {"_id": 2}, {"_id": 3}])
    assert e.value.details["nInserted"] == 1
    with pytest.raises(BulkWriteError) as e:
        c.insert_many([{"_id": 2}, {"_id": 5}, {"_id": 6}], ordered=False)
    assert e.value.details["nInserted"] == 2
    assert ids(c.find()) == [1, 2, 5, 6]
    c.insert_one({"_id": 7, "new": 1.5})
    assert c.find_one(7) == {"_id": 7, "new": 1.5}
    c.insert_one({"_id": 8, "new": "text"})
    c.insert_one({"_id": "8", "new": None})
    assert c.find_one(8)["new"] == "text" and c.find_one("8") == {"_id": "8", "new": None} and c.find_one(7)["new"] == 1.5
    with pytest.raises(DuplicateKeyError):
        c.insert_one({"_id": 8})
    d = {"x": 1}
    db["d"].insert_one(d)
    assert db["d"].find_one({"x": 1})["_id"] == d["_id"]


@pytest.mark.parametrize("update, field, want", [
    ({"$set": {"a": 10}}, "a", 10),
    ({"$set": {"a": 1.5}}, "a", 1.5),
    ({"$set": {"o.p": 9}}, "o", {"p": 9, "q": "u"}),
    ({"$set": {"o.r.s": 9}}, "o", {"p": 1, "q": "u", "r": {"s": 9}}),
    ({"$set": {"fresh.x": "t"}}, "fresh", {"x": "t"}),
    ({"$set": {"tags.3": "w"}}, "tags", ["x", "y", None, "w"]),
    ({"$set": {"l.1.n": 0}}, "l", [{"k": 1, "n": 5}, {"k": 2, "n": 0}]),
    ({"$unset": {"a": ""}}, "a", None),
    ({"$unset": {"o.q": ""}}, "o", {"p": 1, "q": None}),
    ({"$inc": {"a": 4, "fresh": 2}}, "fresh", 2),
    ({"$inc": {"o.p": -3}}, "o", {"p": -2, "q": "u"}),
    ({"$max": {"a": 7}}, "a", 7),
    ({"$min": {"a": 7}}, "a", 1),
    ({"$pop": {"tags": 1}}, "tags", ["x"]),
    ({"$pop": {"tags": -1}}, "tags", ["y"]),
    ({"$rename": {"a": "b"}}, "b", 1),
    ({"$currentDate": {"at": True}}, "at", NOW),
    ({"$addToSet": {"tags": "x"}}, "tags", ["x", "y"]),
    ({"$addToSet": {"tags": {"$each": ["y", "n", "n"]}}}, "tags", ["x", "y", "n", "n"]),
    ({"$push": {"tags": "x"}}, "tags", ["x", "y", "x"]),
    ({"$push": {"tags": {"$each": ["b", "a"], "$position": 1}}}, "tags", ["x", "b", "a", "y"]),
    ({"$push": {"tags": {"$each": ["b", "a"], "$sort": -1, "$slice": 3}}}, "tags", ["y", "x", "b"]),
    ({"$push": {"tags": {"$each": ["b", "a"], "$slice": -1}}}, "tags", ["a"]),
    ({"$push": {"l": {"$each": [{"k": 0, "n": 6}], "$sort": {"n": 1}}}}, "l", [{"k": 1, "n": 5}, {"k": 0, "n": 6}, {"k": 2, "n": 7}]),
    ({"$pull": {"tags": "x"}}, "tags", ["y"]),
    ({"$pull": {"l": {"n": {"$gt": 5}}}}, "l", [{"k": 1, "n": 5}]),
    ({"$pullAll": {"tags": ["y", "q"]}}, "tags", ["x"]),
])
def test_update(docs, update, field, want):
    others = [d for d in docs.find({"_id": {"$ne": 1}})]
    done = docs.update_one({"_id": 1}, update)
    assert done.matched_count == 1
    assert docs.find_one(1)[field] == want
    same = [{k: v for k, v in d.items() if k in others[0]} for d in docs.find({"_id": {"$ne": 1}})]
    if "$rename" not in update and field != "o":
        assert same == others


def test_update_counts(docs):
    done = docs.update_many({"a": 3}, {"$set": {"a": 3}})
    assert (done.matched_count, done.modified_count) == (2, 0)
    assert docs.update_many({}, {"$inc": {"a": 1}}).modified_count == 4
    assert [d["a"] for d in docs.find()] == [2, 3, 4, 4]
    assert docs.update_one({"a": 4}, {"$set": {"a": 0}}).modified_count == 1
    assert [d["a"] for d in docs.find()] == [2, 3, 0, 4]


def test_positional(docs):
    docs.update_one({"_id": 1, "l.k": 2}, {"$set": {"l.$.n": 70}})
    assert docs.find_one(1)["l"] == [{"k": 1, "n": 5}, {"k": 2, "n": 70}]
    docs.update_one({"tags": "z"}, {"$set": {"tags.$": "Z"}})
    assert docs.find_one(4)["tags"] == ["y", "y", "Z"]
    docs.update_one({"l": {"$elemMatch": {"k": 1}}}, {"$inc": {"l.$.n": 1}})
    assert docs.find_one(1)["l"][0]["n"] == 6


def test_update_errors(docs):
    with pytest.raises(ValueError):
        docs.update_one({}, {"a": 1})
    with pytest.raises(ValueError):
        docs.update_one({}, {"$mul": {"a": 2}})
    with pytest.raises(WriteError):
        docs.update_one({}, {"$pop": {"tags": 2}})
    with pytest.raises(WriteError):
        docs.update_one({}, {"$push": {"a": 2}})
    with pytest.raises(WriteError):
        docs.update_one({}, {"$set": {"tags.-1": "x"}})
    with pytest.raises(WriteError):
        docs.update_one({}, {"$set": {"_id": 5}})
    with pytest.raises(NotImplementedError):
        docs.update_one({}, {"$rename": {"o.p": "b"}})
    with pytest.raises(NotImplementedError):
        docs.update_one({}, {"$set": {"a": 1}}, array_filters=[{}])


def test_upsert_and_replace(docs):
    done = docs.update_one({"_id": 9, "o.p": 3, "a": {"$gt": 100}}, {"$set": {"tags": ["n"]}, "$setOnInsert": {"a": 8}}, upsert=True)
    assert done.upserted_id == 9
    assert docs.find_one(9) == {"_id": 9, "a": 8, "tags": ["n"], "o": {"p": 3, "q": None}, "l": None}
    docs.update_one({"_id": 9}, {"$setOnInsert": {"a": 1}, "$set": {"tags": []}}, upsert=True)
    assert docs.find_one(9)["a"] == 8
    assert docs.replace_one({"_id": 1}, {"a": 5}).modified_count == 1
    assert docs.find_one(1) == {"_id": 1, "a": 5, "tags": None, "o": None, "l": None}
    assert docs.replace_one({"_id": 20}, {"a": 6}, upsert=True).upserted_id == 20
    with pytest.raises(WriteError):
        docs.replace_one({"_id": 1}, {"_id": 2})
    with pytest.raises(ValueError):
        docs.replace_one({}, {"$set": {"a": 1}})


def test_delete_and_find_and(docs):
    assert docs.find_one_and_update({"a": 3}, {"$inc": {"a": 10}}, sort=[("_id", -1)])["a"] == 3
    assert docs.find_one(4)["a"] == 13
    assert docs.find_one_and_update({"a": 13}, {"$inc": {"a": 1}}, return_document=AFTER)["a"] == 14
    assert docs.find_one_and_replace({"_id": 2}, {"a": 0}, return_document=AFTER)["a"] == 0
    assert docs.find_one_and_delete({}, sort=[("a", -1)])["_id"] == 4
    assert docs.find_one_and_delete({"a": 99}) is None
    assert docs.delete_one({}).deleted_count == 1
    assert ids(docs.find()) == [2, 3]
    assert docs.delete_many({}).deleted_count == 2
    assert docs.count_documents({}) == 0


def test_bulk(docs):
    done = docs.bulk_write([InsertOne({"_id": 5, "a": 5}), UpdateMany({"a": 3}, {"$set": {"a": 4}}), UpdateOne({"_id": 6}, {"$set": {"a": 6}}, True), ReplaceOne({"_id": 1}, {"a": 0}), DeleteMany({"a": 4})])
    assert (done.inserted_count, done.matched_count, done.deleted_count, done.upserted_ids) == (1, 3, 2, {2: 6})
    with pytest.raises(BulkWriteError) as e:
        docs.bulk_write([InsertOne({"_id": 1}), InsertOne({"_id": 70})])
    assert e.value.details["nInserted"] == 0
    with pytest.raises(BulkWriteError) as e:
        docs.bulk_write([InsertOne({"_id": 1}), InsertOne({"_id": 70})], ordered=False)
    assert e.value.details["nInserted"] == 1
    with pytest.raises(InvalidOperation):
        docs.bulk_write([])


def test_unique(db):
    c = db["u"]
    assert c.create_index([("k", 1), ("m", -1)], unique=True) == "k_1_m_-1"
    c.insert_one({"_id": 1, "k": 1, "m": 1})
    with pytest.raises(DuplicateKeyError):
        c.insert_one({"_id": 2, "k": 1, "m": 1})
    c.insert_one({"_id": 3, "k": 1, "m": 2})
    with pytest.raises(DuplicateKeyError):
        c.update_one({"_id": 3}, {"$set": {"m": 1}})
    assert c.find_one(3)["m"] == 2
    c.drop_index("k_1_m_-1")
    c.insert_one({"_id": 4, "k": 1, "m": 1})
    with pytest.raises(DuplicateKeyError):
        c.create_index("k", unique=True)
    assert set(c.index_information()) == {"_id_"}
    s = db["s"]
    s.create_index("k", unique=True, sparse=True)
    s.insert_many([{"_id": 1}, {"_id": 2}, {"_id": 3, "k": 1}])
    with pytest.raises(DuplicateKeyError):
        s.insert_one({"_id": 4, "k": 1})
    p = db["p"]
    p.create_index("k", unique=True, partialFilterExpression={"on": True})
    p.insert_many([{"_id": 1, "k": 1, "on": True}, {"_id": 2, "k": 1, "on": False}])
    with pytest.raises(DuplicateKeyError):
        p.insert_one({"_id": 3, "k": 1, "on": True})


def test_expiry(db):
    c = db["t"]
    c.insert_many([{"_id": 1, "at": NOW - datetime.timedelta(seconds=61)}, {"_id": 2, "at": NOW - datetime.timedelta(seconds=59)}, {"_id": 3, "at": None}])
    c.create_index("at", expireAfterSeconds=60)
    assert ids(c.find()) == [2, 3]


def test_catalog(db):
    c = db.create_collection("one")
    with pytest.raises(CollectionInvalid):
        db.create_collection("one")
    with pytest.raises(CollectionInvalid):
        db["a..b"]
    c.insert_one({"_id": 1})
    c.sub.insert_one({"_id": 2})
    assert sorted(db.list_collection_names()) == ["one", "one.sub"]
    assert db.list_collection_names({"name": {"$regex": "sub$"}}) == ["one.sub"]
    c.rename("two")
    assert ids(db["two"].find()) == [1]
    with pytest.raises(OperationFailure):
        db.rename_collection("gone", "x")
    with pytest.raises(OperationFailure):
        db.rename_collection("two", "one.sub")
    assert db.dereference("two", 1) == {"_id": 1}
    db.drop_collection("two")
    assert db.list_collection_names() == ["one.sub"]


def test_aggregate(docs, db):
    db["other"].insert_many([{"_id": 1, "a": 3, "w": "q"}])
    out = list(docs.aggregate([{"$match": {"a": 3}}, {"$lookup": {"from": "other", "localField": "a", "foreignField": "a", "as": "found"}}, {"$project": {"found.w": 1}}, {"$out": "made"}]))
    assert [d["found"] for d in out] == [[{"w": "q"}]] * 2
    assert sorted(ids(db["made"].find())) == [3, 4]


def test_map_reduce(docs, db):
    def tags(doc):
        for t in doc["tags"] or ():
            yield t, 1

    assert docs.map_reduce(tags, lambda k, v: sum(v), {"inline": 1}, "int") == [{"_id": "x", "value": 1}, {"_id": "y", "value": 3}, {"_id": "z", "value": 1}]
    docs.map_reduce(tags, lambda k, v: sum(v), "counts", "int", {"_id": 4})
    assert [d["value"] for d in db["counts"].find()] == [2, 1]
    with pytest.raises(TypeError):
        docs.map_reduce("function() {}", "function() {}", "x")
