"""Map-reduce with Python functions.

Values of a key are combined where they are mapped, as far as a bounded table goes, then sorted by key within partitions
and reduced in pieces, so a key of a third of all rows never stands in memory. This leans on what map-reduce asks of
its reduce function anyway: that it accepts its own results among the values.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys a task holds before it hands its combined values on; values of a key reduced at once.
KEYS, PIECE = 50_000, 1_000


def map_reduce(df: DataFrame, map_func: Callable[[dict], Iterator[tuple]], reduce_func: Callable[[str, list], object], value: str = "double") -> DataFrame:
    """map_func yields (key, value) for a document, reduce_func folds a key's values; columns _id and value.

    Keys become strings; a null document field is None. Values are held as JSON between the steps."""
    if not callable(map_func) or not callable(reduce_func):
        raise TypeError("map_reduce takes Python functions")

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"k": list(held), "v": [json.dumps(reduce_func(k, v)) for k, v in held.items()]}, dtype="str")
            held.clear()
            return out

        for batch in batches:
            for doc in batch["d"]:
                for k, v in map_func(json.loads(doc)):
                    some = held.setdefault(k if isinstance(k, str) else str(int(k)) if isinstance(k, float) and k.is_integer() else str(k), [])
                    some.append(v)
                    if len(some) >= PIECE:
                        some[:] = [reduce_func(k, some)]
                if len(held) >= KEYS:
                    yield flush()
        if held:
            yield flush()

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, values = None, []
        for batch in batches:
            ks, vs = [], []
            for k, v in zip(batch["k"], batch["v"], strict=True):
                if k != key and key is not None:
                    ks.append(key)
                    vs.append(json.dumps(reduce_func(key, values)))
                    values = []
                key = k
                values.append(json.loads(v))
                if len(values) >= PIECE:
                    values = [reduce_func(key, values)]
            yield pd.DataFrame({"_id": ks, "v": vs}, dtype="str")
        if key is not None:
            yield pd.DataFrame({"_id": [key], "v": [json.dumps(reduce_func(key, values))]}, dtype="str")

    docs = df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}).alias("d"))
    pairs = docs.mapInPandas(mapped, "k string, v string").repartition("k").sortWithinPartitions("k")
    done = pairs.mapInPandas(folded, "_id string, v string")
    return done.select("_id", F.from_json(F.concat(F.lit('{"x":'), "v", F.lit("}")), f"x {value}")["x"].alias("value"))
