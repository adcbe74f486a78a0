"""What the operators of this folder share: tables in the shared folder, Arrow text batches, hashing."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once; one longer text is handled alone.
SLICE_BYTES = 500_000
#: Settings while a table is written: texts are long, so fewer to an Arrow batch; shuffle files of the finished write go
#: at once instead of with the driver's next garbage collection.
_WRITING = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own where none is set, on a single machine only."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="nestwright-")
        atexit.register(shutil.rmtree, path, True)
        sc.setCheckpointDir(path)
        path = sc.getCheckpointDir() or path
    return f"{path.rstrip('/')}/nestwright-{sc.applicationId}"


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """_WRITING, and afterwards what was there."""
    was = {k: spark.conf.get(k, None) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class _Open(threading.local):
    """Tables written inside each open scratch() of a thread, innermost last."""

    def __init__(self):
        self.written: list[list[DataFrame]] = []


_open = _Open()


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends there and no executor owns the rows."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    with _settings(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if _open.written:
        _open.written[-1].append(out)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(*written: DataFrame) -> None:
    """Deletes tables that materialize() wrote, once what was made of them is written too."""
    for df in written:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, path)
        for made in _open.written:
            made[:] = [x for x in made if x is not df]


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """At its end the tables that were written inside go, but for those put into the list it gives; an enclosing
    scratch() has these."""
    keep: list[DataFrame] = []
    _open.written.append([])
    try:
        yield keep
    finally:
        made = _open.written.pop()
        release(*(x for x in made if not any(x is k for k in keep)))
        if _open.written:
            _open.written[-1] += [x for x in made if any(x is k for k in keep)]


def clear(spark: SparkSession) -> None:
    """Deletes all tables of this application in the shared folder; results that read them can't be computed after."""
    _delete(spark, shared_dir(spark))


def void_safe(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Only the named columns, of these types, so that other columns can't clash with an operator's own."""
    have = set(df.columns)
    return df.select(*((F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in columns.items()))


def text_key(text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a text: with the id they name a row; rows equal in both are copies and fare alike."""
    t = F.coalesce(text, F.lit(""))
    return F.xxhash64(t), F.xxhash64(F.lit(0x5EED), t)


def packed(docs: DataFrame) -> DataFrame:
    """docs with every column in `row`, beside the names of its rows, so that no column of docs can clash."""
    h1, h2 = text_key(F.col("text").cast("string"))
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("bigint").alias("id"), h1.alias("h1"), h2.alias("h2"))


def named(rows: DataFrame) -> DataFrame:
    """Keys for `packed` rows: k_id, k_h1, k_h2 from doc_id, h1, h2."""
    return rows.select(F.col("doc_id").alias("k_id"), F.col("h1").alias("k_h1"), F.col("h2").alias("k_h2"), *(c for c in rows.columns if c not in ("doc_id", "h1", "h2")))


def met() -> Column:
    return F.col("id").eqNullSafe(F.col("k_id")) & (F.col("h1") == F.col("k_h1")) & (F.col("h2") == F.col("k_h2"))


def by(df: DataFrame, *keys: str):
    """groupBy(keys) by their struct `key`. A join of the result with df on the keys then deals both sides out anew, so
    that adaptive execution can split a key that holds many rows; after a plain groupBy it can't."""
    return df.groupBy(F.struct(*keys).alias("key"))


# Arrow batches ---------------------------------------------------------------------------------


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a column, and each one's offsets among them (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return every[ends[0] : ends[-1]], ends - ends[0]


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches of about SLICE_BYTES of text, with the bytes and offsets of the text column."""
    for batch in batches:
        data, offsets = texts(batch.column(column))
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


# Hashing -----------------------------------------------------------------------------------------

_rng = np.random.default_rng(20240601)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, 1 << 16), base, np.uint64)
        full[0] = 1
        have = _powers[base] = np.multiply.accumulate(full)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), in place on a copy."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that don't cross a document's border."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words between ASCII spaces, and each word's document."""
    starts, ends = runs(~SPACE[data], offsets)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; equal bytes have equal hashes wherever they stand."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(BASE, len(data)), out=sums[1:])
    back = powers(_INVERSE, len(data) + 1)
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def run_hashes(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First index of every run of k items of one document, and a hash of the run."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    total = np.zeros(len(at), np.uint64)
    for i in range(k):
        total = mix(total * np.uint64(0xFF51AFD7ED558CCD) + hashes[at + i] + np.uint64(i + 1))
    return at, total
