"""Databases of named collections, each a DataFrame; writes are copy-on-write.

A write computes the whole next table, cuts its lineage with a reliable checkpoint in the cluster's shared folder and
swaps the pointer, so readers of the old DataFrame aren't disturbed. Documents keep the place they were inserted at in
`__seq`. What reaches the driver is counts, the rows a caller iterates over and the keys of a caller's own list.
"""

from __future__ import annotations

import datetime
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestwright import features
from nestwright.errors import BulkWriteError, CollectionInvalid, DuplicateKeyError, InvalidOperation, OperationFailure, WriteError
from nestwright.functions import mixed
from nestwright.functions.expressions import Val, rank
from nestwright.functions.mixed import is_mixed
from nestwright.functions.predicates import compile_filter, sure
from nestwright.functions.updates import compile_update, fitted, inferred, merged, retyped
from nestwright.operators.finds import distinct, find_project
from nestwright.operators.map_reduce import map_reduce
from nestwright.operators.shapes import env_of, shown
from nestwright.plans import pipeline as plans
from nestwright.sources.results import BulkResult, DeleteMany, DeleteOne, DeleteResult, IndexModel, InsertOne, InsertResult, ReplaceOne, UpdateMany, UpdateOne, UpdateResult
from nestwright.sources.shared import cut

BEFORE, AFTER = False, True


class Client:
    """All databases of a session. `clock` gives the time in UTC, without a zone. With `schemaless` every field of an
    inserted document but its id is a VARIANT, which tells a missing field from a null one; without it a field becomes
    one only where values of different types meet in it."""

    def __init__(self, spark: SparkSession, clock: Callable[[], datetime.datetime] | None = None, schemaless: bool = False):
        self.spark, self._found, self.schemaless = spark, {}, schemaless
        self.clock = clock or (lambda: datetime.datetime.now(datetime.UTC).replace(tzinfo=None))

    def __getitem__(self, name: str) -> Database:
        return self._found.setdefault(name, Database(self, name))

    def __getattr__(self, name: str) -> Database:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    get_database = __getitem__

    def __enter__(self) -> Client:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Nothing is held open."""

    def server_info(self) -> dict:
        version = [int(x) for x in self.spark.version.split(".")[:3]]
        return {"version": ".".join(map(str, version)), "versionArray": [*version, 0], "sysInfo": "Spark", "bits": 64, "debug": False, "maxBsonObjectSize": 16777216, "ok": 1}

    def list_database_names(self) -> list[str]:
        return [n for n, d in self._found.items() if d.list_collection_names()]

    def drop_database(self, name: str) -> None:
        self._found.pop(name, None)

    def start_session(self):
        raise NotImplementedError("sessions are not supported")


class Database:
    def __init__(self, client: Client, name: str):
        self.client, self.name, self._found = client, name, {}

    def __getitem__(self, name: str) -> Collection:
        if not name or ".." in name or name[0] == "." or name[-1] == "." or "$" in name or "\x00" in name:
            raise CollectionInvalid(f"{name!r} can't name a collection")
        return self._found.setdefault(name, Collection(self, name))

    def __getattr__(self, name: str) -> Collection:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def get_collection(self, name: str, **options) -> Collection:
        return self[name].with_options(**options)

    def load(self, name: str, df: DataFrame) -> Collection:
        """The collection made to hold a DataFrame, such as a Parquet table."""
        self[name]._df, self[name]._made = df, True
        return self[name]

    def create_collection(self, name: str, **options) -> Collection:
        if options:
            raise NotImplementedError("collections take no options")
        if self[name]._made:
            raise CollectionInvalid(f"collection {name} already exists")
        self[name]._made = True
        return self[name]

    def list_collection_names(self, filter: dict | None = None) -> list[str]:
        names = [n for n, c in self._found.items() if c._made and not n.startswith("system.")]
        for key, test in (filter or {}).items():
            if key != "name":
                raise NotImplementedError("collections are listed by name")
            for how, arg in (test if isinstance(test, dict) else {"$eq": test}).items():
                if how not in ("$eq", "$ne", "$regex"):
                    raise NotImplementedError(f"{how} is not supported in a list of collections")
                keep = {"$eq": lambda n, a=arg: n == a, "$ne": lambda n, a=arg: n != a, "$regex": lambda n, a=arg: re.search(a, n)}[how]
                names = [n for n in names if keep(n)]
        return names

    def list_collections(self):
        raise NotImplementedError("list_collections is not supported")

    def drop_collection(self, which: str | Collection) -> None:
        (which if isinstance(which, Collection) else self[which]).drop()

    def rename_collection(self, name: str, new_name: str, dropTarget: bool = False) -> None:  # noqa: N803
        if not self[name]._made:
            raise OperationFailure("source namespace does not exist")
        if self[new_name]._made and not dropTarget:
            raise OperationFailure("target namespace exists")
        moved = self._found.pop(name)
        moved.name = new_name
        self._found[new_name] = moved

    def dereference(self, collection: str, ref_id) -> dict | None:
        return self[collection].find_one({"_id": ref_id})

    def command(self, name: str) -> dict:
        if name != "ping":
            raise NotImplementedError("only ping is supported")
        return {"ok": 1.0}


class Cursor:
    """A read that hasn't run; `df` is its plan, iteration streams its documents."""

    def __init__(self, collection: Collection, filter_: dict | None, projection=None, sort=None, skip: int = 0, limit: int = 0):
        self._on, self._filter, self._projection, self._sort, self._skip, self._limit = collection, filter_ or {}, projection, _sorting(sort), skip, limit
        self._rows: Iterator | None = None
        self.alive = True

    def _plan(self) -> DataFrame:
        df = self._on.filtered(self._filter)
        if self._sort:
            if "__seq" not in df.columns:
                df = df.withColumn("__seq", F.monotonically_increasing_id())
            df, keys, _ = plans.sort_keys(df, self._sort, False)
            df = df.orderBy(*keys, *([] if "$natural" in self._sort else ["__seq"]))
        elif "__seq" in df.columns:
            df = df.orderBy("__seq")
        if self._skip:
            df = df.offset(self._skip)
        return df.limit(abs(self._limit)) if self._limit else df

    @property
    def df(self) -> DataFrame:
        df = find_project(self._plan(), self._projection)
        return df.select(*(F.col(f"`{c}`") for c in shown(df)))

    def __iter__(self) -> Cursor:
        return self

    def __next__(self) -> dict:
        if self._rows is None:
            df = self.df
            self._rows, self._types = df.toLocalIterator(), df.schema
        try:
            return mixed.document(next(self._rows), self._types)
        except StopIteration:
            self.alive = False
            raise

    next = __next__

    def _set(self, **more) -> Cursor:
        if self._rows is not None:
            raise InvalidOperation("the cursor runs already")
        self.__dict__.update(more)
        return self

    def sort(self, key, direction: int = 1) -> Cursor:
        return self._set(_sort=_sorting([(key, direction)] if isinstance(key, str) else key, True))

    def skip(self, n: int) -> Cursor:
        return self._set(_skip=n)

    def limit(self, n: int) -> Cursor:
        return self._set(_limit=n)

    def __getitem__(self, which):
        if isinstance(which, slice):
            if which.step is not None or (which.start or 0) < 0 or (which.stop is not None and which.stop <= (which.start or 0)):
                raise IndexError("a cursor is cut by rising places without a step")
            return self._set(_skip=which.start or 0, _limit=0 if which.stop is None else which.stop - (which.start or 0))
        if which < 0:
            raise IndexError("cursors have no negative places")
        found = list(self.clone().skip(self._skip + which).limit(1))
        if not found:
            raise IndexError("no such item for the cursor")
        return found[0]

    def clone(self) -> Cursor:
        return Cursor(self._on, self._filter, self._projection, self._sort, self._skip, self._limit)

    def rewind(self) -> Cursor:
        self._rows, self.alive = None, True
        return self

    def distinct(self, key: str) -> list:
        """The distinct values as a list; Collection.distinct_df gives them as a DataFrame."""
        return [mixed.plain(r["value"]) for r in self._on.distinct_df(key, self._filter).collect()]

    def count(self) -> int:
        return self._on.count_documents(self._filter)

    def close(self) -> None:
        self._rows, self.alive = iter(()), False

    def __enter__(self) -> Cursor:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def hint(self, index) -> Cursor:
        return self

    def batch_size(self, n: int) -> Cursor:
        if not isinstance(n, int):
            raise TypeError("batch_size must be an integer")
        return self

    def max_time_ms(self, n: int | None) -> Cursor:
        if n is not None and not isinstance(n, int):
            raise TypeError("max_time_ms must be an integer or None")
        return self

    def allow_disk_use(self, yes: bool = False) -> Cursor:
        if not isinstance(yes, bool):
            raise TypeError("allow_disk_use must be a bool")
        return self


def _sorting(sort, given: bool = False) -> dict:
    if given and not sort:
        raise ValueError("key_or_list must not be the empty list")
    return dict([(sort, 1)] if isinstance(sort, str) else sort) if sort else {}


def _starts(doc: dict, operators: bool) -> None:
    first = next(iter(doc), "")
    if operators and not first.startswith("$"):
        raise ValueError("update only works with $ operators")
    if not operators and first.startswith("$"):
        raise ValueError("replacement can not include $ operators")


def _seed(filter_: dict) -> dict:
    """The document an upsert starts from: the filter's equalities, dots opened."""
    out: dict = {}
    for key, s in filter_.items():
        if key.startswith("$"):
            continue
        if isinstance(s, dict) and any(k.startswith("$") for k in s):
            if "$eq" not in s:
                continue
            s = s["$eq"]
        at, parts = out, key.split(".")
        for p in parts[:-1]:
            at = at.setdefault(p, {})
        at[parts[-1]] = s
    return out


class Collection:
    def __init__(self, database: Database, name: str):
        self.database, self.name, self._df, self._made = database, name, None, False
        self._indexes: dict[str, dict] = {}

    def __getattr__(self, name: str) -> Collection:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.database[f"{self.name}.{name}"]

    __getitem__ = __getattr__

    @property
    def _spark(self) -> SparkSession:
        return self.database.client.spark

    def _live(self) -> DataFrame:
        """The documents that haven't expired."""
        df = self._df if self._df is not None else self._spark.createDataFrame([], T.StructType([T.StructField("_id", T.NullType())]))
        types, now = {f.name: f.dataType for f in df.schema}, self.database.client.clock()
        for index in self._indexes.values():
            after, key = index.get("expireAfterSeconds"), index["key"]
            if len(key) != 1 or isinstance(after, bool) or not isinstance(after, int) or key[0][0] not in types:
                continue
            t, col = types[key[0][0]], F.col(f"`{key[0][0]}`")
            t, col = (t.elementType, F.array_min(col)) if isinstance(t, T.ArrayType) else (t, col)
            if isinstance(t, T.TimestampNTZType | T.TimestampType):
                df = df.where(~sure(col <= F.lit((now - datetime.timedelta(seconds=after)).isoformat(" ")).cast(t)))
        return df

    def filtered(self, filter_: dict) -> DataFrame:
        df = self._live()
        return df.where(compile_filter(filter_, env_of(df)))

    # Reads
    def find(self, filter: dict | None = None, projection=None, skip: int = 0, limit: int = 0, sort=None, **options) -> Cursor:
        if filter is not None and not isinstance(filter, dict):
            raise TypeError("filter must be a mapping")
        features.refuse("session", options.pop("session", None))
        for name, v in options.items():
            if name not in _HINTS and v:
                raise OperationFailure(f"Unrecognized field '{name}'")
        return Cursor(self, filter, projection, sort, skip, limit)

    def find_one(self, filter=None, projection=None, sort=None, **options) -> dict | None:
        filter = filter if filter is None or isinstance(filter, dict) else {"_id": filter}
        return next(iter(self.find(filter, projection, options.pop("skip", 0), 1, sort, **options)), None)

    def count(self, filter: dict | None = None, session=None) -> int:
        features.refuse("session", session)
        return self.filtered(filter or {}).count()

    def distinct_df(self, key: str, filter: dict | None = None) -> DataFrame:
        return distinct(self.filtered(filter or {}), key)

    def distinct(self, key: str, filter: dict | None = None) -> list:
        return self.find(filter).distinct(key)

    def count_documents(self, filter: dict, skip: int = 0, limit: int | None = None, collation=None, session=None, hint=None, maxTimeMS: int | None = None) -> int:  # noqa: N803
        features.refuse("collation", collation)
        features.refuse("session", session)
        if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int | float) or limit <= 0):
            raise OperationFailure("the limit must be positive")
        n = max(self.filtered(filter).count() - skip, 0)
        return n if limit is None else min(n, int(limit))

    def estimated_document_count(self) -> int:
        return self._live().count()

    def aggregate_df(self, pipeline: list[dict]) -> DataFrame:
        return plans.run(self._live(), pipeline, lambda n: self.database[n]._live(), lambda n, df: self.database[n]._replace_all(df))

    def aggregate(self, pipeline: list[dict], **_) -> Iterator[dict]:
        df = self.aggregate_df(pipeline)
        return (mixed.document(r, df.schema) for r in df.toLocalIterator())

    def find_raw_batches(self, *_, **__):
        raise NotImplementedError("raw batches are not supported")

    aggregate_raw_batches = find_raw_batches

    def map_reduce(self, map_func: Callable, reduce_func: Callable, out: str | dict, value: str = "double", query: dict | None = None, limit: int | None = None):
        """Python functions instead of script text; reduce_func must accept its own results again. `value` is the type
        of values as DDL. A named output is replaced, {"inline": 1} gives a list."""
        df = self.filtered(query or {})
        done = map_reduce(df.select(*(F.col(f"`{c}`") for c in shown(df))), map_func, reduce_func, value)
        done = (done.limit(limit) if limit else done).orderBy("_id")
        if isinstance(out, dict) and out.get("inline"):
            return [r.asDict(recursive=True) for r in done.collect()]
        target = self.database[out] if isinstance(out, str) else self.database.client[out.get("db", self.database.name)][out["replace"]]
        target._replace_all(done)
        return target

    def inline_map_reduce(self, map_func: Callable, reduce_func: Callable, **more) -> list[dict]:
        return self.map_reduce(map_func, reduce_func, {"inline": 1}, **more)

    # Writes
    def _replace_all(self, df: DataFrame) -> None:
        self._df, self._made = cut(df.withColumn("__seq", F.monotonically_increasing_id())), True

    def _numbered(self) -> DataFrame:
        df = self._live()
        return df if "__seq" in df.columns else cut(df.withColumn("__seq", F.monotonically_increasing_id()))

    def _store(self, df: DataFrame) -> None:
        self._check_unique(df)
        self._df, self._made = df, True

    def _unique_keys(self) -> list[tuple[str, dict, list[str]]]:
        return [("_id_", {}, ["_id"]), *((n, i, [k for k, _ in i["key"]]) for n, i in self._indexes.items() if i.get("unique"))]

    def _keyed(self, df: DataFrame, index: dict, keys: list[str], beside: DataFrame | None = None) -> DataFrame | None:
        """The rows a unique key binds, with its values as `__u0`, `__u1`...; `beside` has rows they are compared with."""
        env = env_of(df)
        vals = [env.path(k) for k in keys]
        theirs = vals if beside is None else [env_of(beside).path(k) for k in keys]
        vals = [Val(mixed.key(mixed.as_variant(v.col, v.type))) if not v.missing and (is_mixed(v.type) or is_mixed(o.type) or rank(v.type) != rank(o.type) and not o.missing) else v for v, o in zip(vals, theirs, strict=True)]
        if all(v.missing for v in vals) and (keys == ["_id"] or index.get("sparse")):
            return None
        if index.get("partialFilterExpression"):
            df = df.where(compile_filter(index["partialFilterExpression"], env))
        df = df.withColumns({f"__u{i}": F.lit(None) if v.missing else v.col for i, v in enumerate(vals)})
        if keys == ["_id"]:  # rows of a loaded table may have none
            df = df.where(F.col("_id").isNotNull())
        if index.get("sparse"):
            df = df.where(F.coalesce(*(F.when(~mixed.is_null(env.path(k).col) if is_mixed(env.path(k).type) else F.col(f"__u{i}").isNotNull(), 1) for i, k in enumerate(keys))).isNotNull())
        return df

    def _check_unique(self, df: DataFrame) -> None:
        for name, index, keys in self._unique_keys():
            rows = self._keyed(df, index, keys)
            if rows is not None and rows.groupBy(*(F.col(f"__u{i}") for i in range(len(keys)))).count().where("count > 1").limit(1).count():
                raise DuplicateKeyError(f"duplicate key in {name}")

    def insert(self, data, **options):
        """A document's id, or the ids of a list's."""
        if isinstance(data, dict):
            return self.insert_one(data, **options).inserted_id
        return self.insert_many(data, **options).inserted_ids

    def save(self, document: dict):
        """Inserts a document without an id, and puts one with an id in its place."""
        if not isinstance(document, dict):
            raise TypeError("document must be a mapping")
        if "_id" not in document:
            return self.insert(document)
        self.replace_one({"_id": document["_id"]}, document, upsert=True)
        return document["_id"]

    def update(self, spec: dict, document: dict, upsert: bool = False, multi: bool = False) -> dict:
        operators = any(k.startswith("$") for k in document)
        if multi and not operators:
            raise WriteError("multi update only works with $ operators")
        done = self._update(spec, document, multi, upsert) if operators else self.replace_one(spec, document, upsert)
        return {"ok": 1.0, "n": done.matched_count or int(done.upserted_id is not None), "nModified": done.modified_count, "updatedExisting": done.matched_count > 0, "upserted": done.upserted_id}

    def remove(self, spec_or_id=None, multi: bool = True) -> dict:
        spec = {} if spec_or_id is None else spec_or_id if isinstance(spec_or_id, dict) else {"_id": spec_or_id}
        return {"ok": 1.0, "n": self._delete(spec, multi).deleted_count}

    def insert_one(self, document: dict, **more) -> InsertResult:
        _refuse(more)
        if not isinstance(document, dict):
            raise TypeError("document must be a mapping")
        try:
            return self.insert_many([document])
        except BulkWriteError as e:
            raise DuplicateKeyError(e.details["writeErrors"][0]["errmsg"]) from None

    def insert_many(self, documents: Iterable[dict], ordered: bool = True, **more) -> InsertResult:
        """A caller's list; an ordered one stops at its first duplicate, another one skips duplicates."""
        _refuse(more)
        documents = list(documents)
        if not documents:
            raise TypeError("documents must be a non-empty list")
        for d in documents:
            if any(k.startswith("$") or k.startswith("__") or "." in k for k in d):
                raise WriteError("field names can't begin with $ or __, nor hold dots")
            d.setdefault("_id", uuid.uuid4().hex[:24])
        t = T.StructType([T.StructField("_id", T.NullType())])
        for d in documents:
            t = merged(t, inferred(d))
        if self.database.client.schemaless:
            t = T.StructType([f if f.name == "_id" else T.StructField(f.name, T.VariantType()) for f in t])
        base = self._numbered() if self._df is not None else None
        if base is not None:  # numbers as the table has them
            t = T.StructType([f for f in merged(T.StructType([f for f in base.schema if not f.name.startswith("__")]), t) if f.name in t.fieldNames()])
        rows = self._spark.createDataFrame([_record(d, t) + (i,) for i, d in enumerate(documents)], T.StructType([*t, T.StructField("__seq", T.LongType())]))
        taken = self._taken(base, rows)
        errors, kept = [], []
        for i in range(len(documents)):
            clash = next((n for n, firsts in taken.items() if firsts.get(i, False)), None)
            if clash is None:
                kept.append(i)
                continue
            errors.append({"index": i, "code": 11000, "errmsg": f"E11000 duplicate key error in {clash}", "op": documents[i]})
            if ordered:
                break
        if kept:
            self.insert_df(rows if len(kept) == len(documents) else rows.where(F.col("__seq").isin(kept)), base, False)
        if errors:
            raise BulkWriteError({"writeErrors": errors, "nInserted": len(kept)})
        return InsertResult([d["_id"] for d in documents])

    def _taken(self, base: DataFrame | None, rows: DataFrame) -> dict[str, dict[int, bool]]:
        """For each unique key the places of the list whose key is in the table or earlier in the list."""
        out = {}
        for name, index, keys in self._unique_keys():
            new = self._keyed(rows, index, keys, base)
            if new is None:
                continue
            cols = [f"__u{i}" for i in range(len(keys))]
            firsts = new.groupBy(*cols).agg(F.min("__seq").alias("__first"))
            on = [new[c].eqNullSafe(firsts[c]) for c in cols]
            bad = {r[0] for r in new.join(firsts, on).where(new["__seq"] > firsts["__first"]).select(new["__seq"]).collect()}
            old = self._keyed(base, index, keys, rows) if base is not None else None
            if old is not None:
                there = old.select(*(F.col(c).alias(f"__o{c}") for c in cols))
                bad |= {r[0] for r in new.join(there, [new[c].eqNullSafe(there[f"__o{c}"]) for c in cols], "left_semi").select("__seq").collect()}
            out[name] = dict.fromkeys(bad, True)
        return out

    def insert_df(self, rows: DataFrame, base: DataFrame | None = None, checked: bool = True) -> None:
        """A DataFrame's rows at the end, for inserts larger than a driver's list; one duplicate refuses all of them."""
        if "__seq" not in rows.columns:
            rows = rows.withColumn("__seq", F.monotonically_increasing_id())
        base = base if base is not None else self._numbered() if self._df is not None else None
        if base is not None:
            last = base.agg(F.max("__seq")).first()[0]
            t = merged(_fields(base), _fields(rows))
            rows = _as(rows.withColumn("__seq", F.col("__seq") + ((-1 if last is None else last) + 1)), t)
            rows = _as(base, t).unionByName(rows)
        done = cut(rows)
        if checked:
            self._check_unique(done)
        self._df, self._made = done, True

    def _write(self, filter_: dict, changes: Callable[[DataFrame, Column, dict[str, Val]], dict[str, Val]], multi: bool, seq: int | None = None) -> UpdateResult:
        """The next table with the changes where the filter matches; only its first row if not multi."""
        if self._df is None:
            return UpdateResult(0, 0)
        df = self._numbered()
        match = sure(compile_filter(filter_, env_of(df)))
        if seq is None and not multi:
            seq = df.where(match).agg(F.min("__seq")).first()[0]
            if seq is None:
                return UpdateResult(0, 0)
        if seq is not None:
            match = F.col("__seq") == seq
        state = _state(df)
        new = changes(df, match, state)
        differs = F.lit(False)
        for name, v in new.items():
            if name not in state:
                differs = differs | v.col.isNotNull()
            elif v is not state[name]:
                old, new_col = retyped(state[name], v.type), v.col
                differs = differs | ~((mixed.key(new_col) == mixed.key(old)) & (new_col.isNull() == old.isNull()) if is_mixed(v.type) else new_col.eqNullSafe(old))
        done = cut(df.select(*(v.col.alias(n) for n, v in new.items()), "__seq", match.alias("__match"), (match & differs).alias("__differs")))
        matched, modified = done.agg(F.count_if("__match"), F.count_if("__differs")).first()
        if matched:
            self._store(done.drop("__match", "__differs"))
        return UpdateResult(matched, modified)

    def _now(self) -> datetime.datetime:
        return self.database.client.clock()

    def _update(self, filter_: dict, update: dict, multi: bool, upsert: bool, seq: int | None = None) -> UpdateResult:
        _starts(update, True)

        def changes(df: DataFrame, match: Column, state: dict[str, Val]) -> dict[str, Val]:
            return compile_update(update, state, match, env_of(df), filter_, False, self._now())

        done = self._write(filter_, changes, multi, seq)
        if done.matched_count or not upsert:
            return done
        seed = {"_id": uuid.uuid4().hex[:24]} | _seed(filter_)
        one = self._spark.createDataFrame([_row(seed, inferred(seed))], inferred(seed))
        state = compile_update(update, _state(one), F.lit(True), env_of(one), filter_, True, self._now())
        made = one.select(*(v.col.alias(n) for n, v in state.items()))
        self.insert_df(made)
        return UpdateResult(0, 0, made.first()["_id"])

    def update_one(self, filter: dict, update: dict, upsert: bool = False, **more) -> UpdateResult:
        _refuse(more)
        return self._update(filter, update, False, upsert)

    def update_many(self, filter: dict, update: dict, upsert: bool = False, **more) -> UpdateResult:
        _refuse(more)
        return self._update(filter, update, True, upsert)

    def replace_one(self, filter: dict, replacement: dict, upsert: bool = False, seq: int | None = None, **more) -> UpdateResult:
        _refuse(more)
        _starts(replacement, False)

        def changes(df: DataFrame, match: Column, state: dict[str, Val]) -> dict[str, Val]:
            if "_id" in replacement and df.where(match).where(~sure(compile_filter({"_id": replacement["_id"]}, env_of(df)))).limit(1).count():
                raise WriteError("the field _id can't be changed")
            state = {n: Val(F.when(~match, v.col), v.type) if n != "_id" else v for n, v in state.items()}
            sets = {k: v for k, v in replacement.items() if k != "_id"}
            for k, v in sets.items():
                new = fitted(v, state[k].type if k in state else None)
                old = retyped(state[k], new.type) if k in state else F.lit(None).cast(new.type)
                state[k] = Val(F.when(match, new.col).otherwise(old), new.type)
            return state

        done = self._write(filter, changes, False, seq)
        if done.matched_count or not upsert:
            return done
        doc = {k: v for k, v in _seed(filter).items() if k == "_id"} | replacement
        return UpdateResult(0, 0, self.insert_one(dict(doc)).inserted_id)

    def _delete(self, filter_: dict, multi: bool, seq: int | None = None) -> DeleteResult:
        if self._df is None:
            return DeleteResult(0)
        df = self._numbered()
        match = sure(compile_filter(filter_, env_of(df)))
        if seq is None and not multi:
            seq = df.where(match).agg(F.min("__seq")).first()[0]
            if seq is None:
                return DeleteResult(0)
        gone = match if seq is None else F.col("__seq") == seq
        n = df.where(gone).count()
        if n:
            self._df = cut(df.where(~gone))
        return DeleteResult(n)

    def delete_one(self, filter: dict, **more) -> DeleteResult:
        _refuse(more)
        return self._delete(filter, False)

    def delete_many(self, filter: dict, **more) -> DeleteResult:
        _refuse(more)
        return self._delete(filter, True)

    def _pick(self, filter_: dict, sort) -> int | None:
        if self._df is None:
            return None
        self._df = self._numbered()
        first = Cursor(self, filter_, None, sort, 0, 1)._plan().select("__seq").first()
        return None if first is None else first[0]

    def _at(self, seq: int, projection) -> dict | None:
        df = find_project(self._df.where(F.col("__seq") == seq), projection).drop("__seq")
        row = df.first()
        return mixed.document(row, df.schema) if row else None

    def find_one_and_delete(self, filter: dict, projection=None, sort=None) -> dict | None:
        seq = self._pick(filter, sort)
        if seq is None:
            return None
        found = self._at(seq, projection)
        self._delete({}, False, seq)
        return found

    def _find_and(self, write: Callable[[int | None], UpdateResult], filter_: dict, projection, sort, upsert: bool, after: bool) -> dict | None:
        seq = self._pick(filter_, sort)
        if seq is None:
            if not upsert:
                return None
            done = write(None)
            return self.find_one({"_id": done.upserted_id}, projection) if after else None
        found = self._at(seq, projection)
        write(seq)
        return self._at(seq, projection) if after else found

    def find_one_and_update(self, filter: dict, update: dict, projection=None, sort=None, upsert: bool = False, return_document: bool = BEFORE) -> dict | None:
        return self._find_and(lambda seq: self._update(filter, update, False, upsert, seq), filter, projection, sort, upsert, return_document)

    def find_one_and_replace(self, filter: dict, replacement: dict, projection=None, sort=None, upsert: bool = False, return_document: bool = BEFORE) -> dict | None:
        return self._find_and(lambda seq: self.replace_one(filter, replacement, upsert, seq), filter, projection, sort, upsert, return_document)

    def find_and_modify(self, query: dict | None = None, update: dict | None = None, upsert: bool = False, sort=None, fields=None, remove: bool = False, new: bool = False) -> dict | None:
        if new and remove:
            raise OperationFailure("remove and returnNew can't co-exist")
        if not (remove or update):
            raise ValueError("Must either update or remove")
        if remove and update:
            raise ValueError("Can't do both update and remove")
        if remove:
            return self.find_one_and_delete(query or {}, fields, sort)
        change = self.find_one_and_update if next(iter(update)).startswith("$") else self.find_one_and_replace
        return change(query or {}, update, fields, sort, upsert, AFTER if new else BEFORE)

    def group(self, key, condition, initial, reduce, finalize=None):
        raise OperationFailure("no such command: 'group'")

    def with_options(self, codec_options=None, read_preference=None, write_concern=None, read_concern=None) -> Collection:
        """The same documents under other options; they are kept and change nothing here."""
        options = {k: v for k, v in {"codec_options": codec_options, "read_preference": read_preference, "write_concern": write_concern, "read_concern": read_concern}.items() if v is not None}
        return _View(self, options) if options else self

    def bulk_write(self, requests: list, ordered: bool = True) -> BulkResult:
        if not requests:
            raise InvalidOperation("No operations to execute")
        out, errors, i = BulkResult(), [], 0
        while i < len(requests) and not (errors and ordered):
            r, n = requests[i], 1
            try:
                if isinstance(r, InsertOne):  # inserts in a row are one write
                    while i + n < len(requests) and isinstance(requests[i + n], InsertOne):
                        n += 1
                    self.insert_many([x.document for x in requests[i : i + n]], ordered)
                    out.inserted_count += n
                elif isinstance(r, DeleteOne | DeleteMany):
                    out.deleted_count += self._delete(r.filter, isinstance(r, DeleteMany)).deleted_count
                elif isinstance(r, UpdateOne | UpdateMany | ReplaceOne):
                    done = self.replace_one(r.filter, r.replacement, r.upsert) if isinstance(r, ReplaceOne) else self._update(r.filter, r.update, isinstance(r, UpdateMany), r.upsert)
                    out.matched_count += done.matched_count
                    out.modified_count += done.modified_count
                    if done.upserted_id is not None:
                        out.upserted_ids[i] = done.upserted_id
                else:
                    raise TypeError(f"{r!r} is not a valid request")
            except BulkWriteError as e:
                out.inserted_count += e.details["nInserted"]
                errors += [x | {"index": i + x["index"]} for x in e.details["writeErrors"]]
            except WriteError as e:
                errors.append({"index": i, "errmsg": str(e)})
            i += n
        if errors:
            raise BulkWriteError({"writeErrors": errors, "nInserted": out.inserted_count, "nMatched": out.matched_count, "nModified": out.modified_count, "nRemoved": out.deleted_count, "nUpserted": out.upserted_count})
        return out

    # Catalog
    def drop(self) -> None:
        self._df, self._made, self._indexes = None, False, {}

    def rename(self, new_name: str, dropTarget: bool = False) -> None:  # noqa: N803
        self.database.rename_collection(self.name, new_name, dropTarget)

    def create_index(self, keys, name: str | None = None, **options) -> str:
        keys = [(keys, 1)] if isinstance(keys, str) else list(keys)
        name = name or "_".join(f"{k}_{d}" for k, d in keys)
        index = {"key": keys} | {k: v for k, v in options.items() if v is not None and k in ("unique", "sparse", "expireAfterSeconds", "partialFilterExpression")}
        if self._indexes.get(name, index) != index:
            raise OperationFailure(f"the index {name} exists with other options")
        was = dict(self._indexes)
        self._indexes[name], self._made = index, True
        if index.get("unique") and self._df is not None:
            try:
                self._check_unique(self._live())
            except DuplicateKeyError:
                self._indexes = was
                raise
        return name

    def ensure_index(self, keys, cache_for: int = 300, **options) -> str:
        return self.create_index(keys, **options)

    def create_indexes(self, indexes: list[IndexModel]) -> list[str]:
        for i in indexes:
            if not isinstance(i, IndexModel):
                raise TypeError(f"{i!r} is not an IndexModel")
        return [self.create_index(i.keys, i.name, **i.options) for i in indexes]

    def reindex(self) -> None:
        """Indexes are read from the documents, so there is nothing to build."""

    def index_information(self) -> dict[str, dict]:
        return {n: i | {"v": 2} for n, i in (({"_id_": {"key": [("_id", 1)]}} if self._made else {}) | self._indexes).items()}

    def list_indexes(self) -> Iterator[dict]:
        return iter([i | {"key": dict(i["key"]), "name": n} for n, i in self.index_information().items()])

    def drop_index(self, which) -> None:
        name = which if isinstance(which, str) else "_".join(f"{k}_{d}" for k, d in which)
        if self._indexes.pop(name, None) is None:
            raise OperationFailure(f"index not found with name [{name}]")

    def drop_indexes(self) -> None:
        self._indexes = {}


class _View(Collection):
    """A collection under other options."""

    def __init__(self, of: Collection, options: dict):
        self.__dict__.update(database=of.database, name=of.name, _of=of, options=options)

    def __setattr__(self, name: str, value) -> None:
        setattr(self._of, name, value)

    _df = property(lambda self: self._of._df)
    _made = property(lambda self: self._of._made)
    _indexes = property(lambda self: self._of._indexes)


def _refuse(options: dict) -> None:
    for name, v in options.items():
        if name in ("session", "collation", "array_filters", "let"):
            features.refuse(name, v)
        elif name not in ("bypass_document_validation", "hint", "manipulate", "check_keys"):
            raise TypeError(f"unexpected option {name}")


#: Options of a read that say how to run it, which is Spark's matter here.
_HINTS = {"no_cursor_timeout", "cursor_type", "allow_partial_results", "oplog_replay", "modifiers", "batch_size", "manipulate", "collation", "max_time_ms", "allow_disk_use", "hint"}


def _state(df: DataFrame) -> dict[str, Val]:
    types = {f.name: f.dataType for f in df.schema}
    return {c: Val(F.col(f"`{c}`"), types[c]) for c in shown(df)}


def _fields(df: DataFrame) -> T.StructType:
    return T.StructType([f for f in df.schema if f.name != "__seq"])


def _as(df: DataFrame, t: T.StructType) -> DataFrame:
    own = {f.name: f.dataType for f in df.schema}
    return df.select(*(retyped(Val(F.col(f"`{f.name}`"), own[f.name]) if f.name in own else Val(None), f.dataType).alias(f.name) for f in t), "__seq")


def _record(document: dict, t: T.StructType) -> tuple:
    """A document as a row; what it lacks of fields of mixed types is missing, not null."""
    return tuple(_row(document.get(f.name), f.dataType) if f.name in document or not is_mixed(f.dataType) else None for f in t)


def _row(value, t: T.DataType):
    """A Python value as createDataFrame wants it for a type."""
    if is_mixed(t):
        return mixed.encoded(value)
    if value is None:
        return None
    if isinstance(t, T.StructType):
        return tuple(_row(value.get(f.name), f.dataType) for f in t)
    if isinstance(t, T.ArrayType):
        return [_row(x, t.elementType) for x in value]
    if isinstance(t, T.FloatType | T.DoubleType):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None, microsecond=value.microsecond // 1000 * 1000)
    return value
