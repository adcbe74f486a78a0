"""Exact substring dedup by refining q-gram buckets.

Every byte that a 400-byte string covers which also starts elsewhere (same document or another) is removed. A pointer
stands for a 400-byte window. Each window names its least q-gram (by hash, leftmost), so equal windows name the same
q-gram at the same distance: a window's pointer is the place of its q-gram and that distance, its initial bucket is the
q-gram, and windows that follow each other and name one occurrence are one run. Runs that are equal as a whole need no
refinement: one of each kind goes on, with their number.

Refinement is recursive. A node is a range of distances in one run (at first all of them, then WIDTHS at a time, at last
one). All its windows share a core around the q-gram, and the bucket identifier of a node is that of its core: the
identifier of the bucket that it comes from, joined with what stands at the offsets right after and right before that
bucket's core. So every step compares only the bytes that it adds and reuses the bucket that the step before has found.
Nodes are sorted into the new buckets by a shuffle on those identifiers. A bucket of one node in one copy is settled, as
nothing else holds any of its windows; so are nodes whose whole bytes occur twice, all of whose windows are repeated
(one of them stays as a witness while its bucket holds others). The rest is refined again. Identifiers are 128-bit
digests of (bucket, later bytes, earlier bytes) where one machine would number the sorted pairs, so no bucket is ever
gathered in a task, however many pointers it has: every step is a count and a join.

Narrower windows come first: a 400-byte string that starts twice lies inside strings of `narrow` bytes that do, so the
wide windows are looked for only in what the narrow ones cover. Those bytes are reported beside the removed ones.

Null and empty texts, and texts under 400 bytes, lose nothing. Repeated rows are copies of each other and lose all
that a window covers. Ids may be null; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestwright.llm import common as C

WINDOW, NARROW, QGRAM = 400, 256, 32
#: Distances that nodes hold together, refinement by refinement.
WIDTHS = (16, 1)
_KEY = ("doc_id", "h1", "h2")
_PLACE = np.uint64((1 << 31) - 1)


def qgram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes from each position."""
    words = np.ascontiguousarray(np.lib.stride_tricks.as_strided(data[:8].view("<u8"), (len(data) - 7,), (1,)))
    words *= np.uint64(0x9E3779B97F4A7C15)
    words ^= words >> np.uint64(29)
    two = words[:-8] * np.uint64(0xC2B2AE3D27D4EB4F) + words[8:]
    two ^= two >> np.uint64(31)
    return C.mix(two[:-16] * np.uint64(0x165667B19E3779F9) + two[16:])


def least_in_window(key: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive keys."""
    n = len(key)
    padded = np.full(-(-n // w) * w, np.uint64(2**64 - 1), np.uint64)
    padded[:n] = key
    grid = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def window_runs(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last start of each run of windows, the place of its q-gram, and the q-gram's hash."""
    none = np.zeros(0, np.int64)
    long = np.flatnonzero(np.diff(offsets) >= window)
    if not len(long):
        return none, none, none, none
    grams = qgram_hashes(data)
    key = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    least = least_in_window(key, window - QGRAM + 1)
    mark = np.zeros(len(data) + 1, np.int32)
    np.add.at(mark, offsets[long], 1)
    np.add.at(mark, offsets[long + 1] - window + 1, -1)
    starts = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
    own = least[starts]
    new = np.append(True, (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    place = (own[first] & _PLACE).astype(np.int64)
    return starts[first], starts[last], place, grams[place].view(np.int64)


def _digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit digests of byte spans, as pairs of 64-bit words."""
    view, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), np.int64).reshape(-1, 2)


def _runs(window: int):
    """Runs of windows: of whole texts, or only of their `ranges` of bytes where the batches have some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in C.sliced(batches):
            owner, base = np.arange(len(batch)), np.zeros(len(batch), np.int64)
            if "ranges" in batch.schema.names:
                listed = batch.column("ranges")
                flat = listed.flatten()
                lo, hi = (np.asarray(flat.field(c)).astype(np.int64) for c in ("lo", "hi"))
                owner, base = np.repeat(owner, np.diff(np.asarray(listed.offsets))), lo
                data = np.concatenate([data[x:y] for x, y in zip((offsets[owner] + lo).tolist(), (offsets[owner] + hi).tolist(), strict=True)]) if len(lo) else data[:0]
                offsets = np.append(0, np.cumsum(hi - lo))
            first, last, place, bucket = window_runs(data, offsets, window)
            if not len(first):
                continue
            f = _digests(data, first, last + window)
            part = np.searchsorted(offsets, first, "right") - 1
            back, at = base[part] - offsets[part], pa.array(owner[part])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in _KEY), *(pa.array((x + back).astype(np.int32)) for x in (first, last, place)), pa.array(bucket), pa.array(f[:, 0]), pa.array(f[:, 1])], [*_KEY, "s0", "s1", "place", "bucket", "f0", "f1"])

    return run


def _bytes(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in C.sliced(batches):
            listed = batch.column("runs")
            flat, counts = listed.flatten(), np.diff(np.asarray(listed.offsets))
            at = offsets[np.repeat(np.arange(len(batch)), counts)]
            s0, s1 = (np.asarray(flat.field(c)).astype(np.int64) for c in ("s0", "s1"))
            view = data.tobytes()
            held = [view[a:b] for a, b in zip((at + s0).tolist(), (at + s1 + window).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([flat.field("id"), pa.array(held, pa.binary())], ["id", "bytes"])

    return run


_NODES = "id bigint, n bigint, witness boolean, lo int, hi int, b0 bigint, b1 bigint, u0 bigint, u1 bigint"


def _refined(window: int, wide: int, width: int):
    """Nodes `width` wide from nodes `wide` wide (0: all distances): id and n of the run, whether all its windows are
    known to be repeated, the range of distances, and identifiers of the core and of all bytes."""
    most, digest = window - QGRAM, xxhash.xxh3_128_digest

    def core(lo: int, step: int) -> tuple[int, int]:
        """Least and largest distance of the whole node that a distance falls in."""
        at = lo // step * step if step else 0
        return at, min(at + step - 1, most) if step else most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids = [], []
            for i, held, far, nodes in zip(*(batch.column(c).to_pylist() for c in ("id", "bytes", "far", "nodes")), strict=True):
                view = memoryview(held)
                for node in nodes:
                    above, (p0, p1) = struct.pack("<qq", node["b0"], node["b1"]), core(node["lo"], wide)
                    lo = node["lo"]
                    while lo <= node["hi"]:
                        c0, c1 = core(lo, width)
                        hi = min(c1, node["hi"])
                        # Offsets are counted in the held bytes; the q-gram stands at `far`.
                        bucket = digest(b"".join((above, struct.pack("<i", c0), view[far - p1 + window : far - c1 + window], view[far - c0 : far - p0])) if p1 - p0 != c1 - c0 else above)
                        whole = bucket if lo == hi == c0 == c1 else digest(b"".join((bucket, struct.pack("<ii", lo, hi), view[far - c1 + window : far - lo + window], view[far - hi : far - c0])))
                        rows.append((i, node["n"], node["witness"], lo, hi))
                        ids += [bucket, whole]
                        lo = hi + 1
            d = np.frombuffer(b"".join(ids), np.int64).reshape(-1, 4)
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, kinds, strict=True)), *(pa.array(d[:, j]) for j in range(4))], ["id", "n", "witness", "lo", "hi", "b0", "b1", "u0", "u1"])

    return run


def refined(held: DataFrame, window: int, widths: tuple[int, ...]) -> DataFrame:
    """id, lo, hi: distances whose windows occur twice, from runs (id, n copies, bytes, bucket, near, far distance)."""
    root = F.struct(F.col("near").alias("lo"), F.col("far").alias("hi"), "n", (F.col("n") > 1).alias("witness"), F.col("bucket").alias("b0"), F.lit(0).cast("bigint").alias("b1"))
    bytes_, todo = held.select("id", "bytes", "far"), held.select("id", "bytes", "far", F.array(root).alias("nodes"))
    found = []
    for wide, width in zip((0, *widths), widths, strict=False):
        nodes = C.materialize(todo.mapInArrow(_refined(window, wide, width), _NODES))
        # Nodes that are equal in all bytes are one from here on; two of them are repeated in all their windows.
        kinds = nodes.groupBy("b0", "b1", "u0", "u1").agg(F.sum("n").alias("n"), F.min(F.struct("id", "lo", "hi")).alias("x"), F.max("witness").alias("witness"))
        kinds = kinds if width == widths[-1] else C.materialize(kinds)
        twice = kinds.where("n > 1").select("u0", "u1")
        found.append(nodes.where("not witness").join(twice, ["u0", "u1"], "left_semi").select("id", "lo", "hi"))
        # A bucket is refined if it holds several kinds of node and one of them isn't settled.
        go = C.by(kinds, "b0", "b1").agg(F.count("*").alias("several"), F.min(F.col("witness") | (F.col("n") > 1)).alias("settled")).where("several > 1 and not settled").select("key.b0", "key.b1")
        onward = kinds.join(go, ["b0", "b1"], "left_semi").select("x.id", F.struct("x.lo", "x.hi", "n", (F.col("witness") | (F.col("n") > 1)).alias("witness"), "b0", "b1").alias("node"))
        # At most a window's distances in one run.
        todo = bytes_.join(onward.groupBy("id").agg(F.collect_list("node").alias("nodes")), "id")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def repeated_ranges(keyed: DataFrame, window: int = WINDOW, widths: tuple[int, ...] = WIDTHS, inside: DataFrame | None = None) -> DataFrame:
    """doc_id, h1, h2 (hashes of the text), ranges (lo, hi: maximal runs of bytes that repeated windows cover). keyed
    has doc_id, h1, h2, text; inside, if given, has ranges of documents outside of which nothing is looked for."""
    looked = keyed if inside is None else _met(keyed, inside, ["ranges"], "inner")
    with C.scratch() as keep:
        of_doc = _ranges(keyed, looked, window, widths)
        keep.append(of_doc)
    return of_doc


def _ranges(keyed: DataFrame, looked: DataFrame, window: int, widths: tuple[int, ...]) -> DataFrame:
    runs = C.materialize(looked.mapInArrow(_runs(window), "doc_id bigint, h1 bigint, h2 bigint, s0 int, s1 int, place int, bucket bigint, f0 bigint, f1 bigint"))
    kinds = C.materialize(runs.groupBy("bucket", "f0", "f1").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in (*_KEY, "s0", "s1", "place"))))
    equal = C.materialize(runs.join(kinds.where("n > 1").select("bucket", "f0", "f1"), ["bucket", "f0", "f1"], "left_semi").select(*_KEY, F.col("s0").alias("lo"), (F.col("s1") + window).alias("hi")))
    C.release(runs)
    # Buckets with different runs: one run of each kind goes on, with its bytes.
    several = C.by(kinds, "bucket").count().where("count > 1").select("key.bucket")
    open_ = C.materialize(kinds.join(several, "bucket", "left_semi").withColumn("id", F.monotonically_increasing_id()))
    C.release(kinds)
    of_doc = open_.groupBy(*_KEY).agg(F.collect_list(F.struct("id", "s0", "s1")).alias("runs"))  # at most a document's length
    met = _met(keyed, of_doc, ["runs"], "inner")
    held = met.select("text", "runs").mapInArrow(_bytes(window), "id bigint, bytes binary").dropDuplicates(["id"])
    held = C.materialize(held.join(open_.select("id", "n", "bucket", (F.col("place") - F.col("s1")).alias("near"), (F.col("place") - F.col("s0")).alias("far")), "id"))
    found = refined(held, window, widths)
    ranges = found.join(open_.select("id", *_KEY, "place"), "id").select(*_KEY, (F.col("place") - F.col("hi")).alias("lo"), (F.col("place") - F.col("lo") + window).alias("hi"))
    listed = equal.unionByName(ranges).groupBy(*_KEY).agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("ranges"))  # at most a document's length
    return C.materialize(listed.select(*_KEY, joined_ranges(F.col("ranges")).alias("ranges")))


def joined_ranges(ranges: Column) -> Column:
    """Maximal ranges from sorted ones that may touch or overlap."""
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    start = F.struct(none.alias("done"), F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"))

    def add(s: Column, r: Column) -> Column:
        goes_on = s["hi"].isNotNull() & (r["lo"] <= s["hi"])
        done = F.when(goes_on | s["hi"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(F.struct(s["lo"].alias("lo"), s["hi"].alias("hi")))))
        return F.struct(done.alias("done"), F.when(goes_on, s["lo"]).otherwise(r["lo"]).alias("lo"), F.when(goes_on, F.greatest(s["hi"], r["hi"])).otherwise(r["hi"]).alias("hi"))

    return F.aggregate(ranges, start, add, lambda s: F.when(s["hi"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"))))))


def _keyed(docs: DataFrame) -> DataFrame:
    rows = C.void_safe(docs, {"doc_id": "bigint", "text": "string"})
    h1, h2 = C.text_key(F.col("text"))
    return rows.select("doc_id", h1.alias("h1"), h2.alias("h2"), "text")


def _met(keyed: DataFrame, of_doc: DataFrame, columns: list[str], how: str) -> DataFrame:
    d, o = keyed.alias("d"), of_doc.alias("o")
    on = F.col("d.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("d.h1") == F.col("o.h1")) & (F.col("d.h2") == F.col("o.h2"))
    return d.join(o, on, how).select("d.*", *(f"o.{c}" for c in columns))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    spans = lambda ranges: [{"start": r["lo"], "end": r["hi"]} for r in ranges or ()]
    for batch, data, offsets in C.sliced(batches):
        size, removed, kept = [], [], []
        for i, ranges in enumerate(batch.column("ranges").to_pylist()):
            own = data[offsets[i] : offsets[i + 1]].tobytes()
            removed.append(spans(ranges))
            cuts = [0, *(x for s in removed[-1] for x in (s["start"], s["end"])), len(own)]
            size.append(len(own))
            kept.append(b"".join(own[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
        near = [spans(r) for r in batch.column("narrow").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, spans_type), pa.array(kept, pa.binary()), pa.array(near, spans_type)], ["doc_id", "n_bytes", "removed", "kept", "repeated"])


def dedup_substrings(docs: DataFrame, window: int = WINDOW, narrow: int = NARROW) -> DataFrame:
    """doc_id, n_bytes, removed (maximal byte runs taken out), kept (the bytes left; cuts may fall inside a character),
    repeated (maximal byte runs that strings of `narrow` bytes cover which also start elsewhere; not taken out)."""
    if not QGRAM < narrow <= window:
        raise ValueError(f"narrow is more than {QGRAM} and at most window")
    keyed = _keyed(docs)
    small = repeated_ranges(keyed, narrow)
    inside = small.select(*_KEY, F.filter("ranges", lambda r: r["hi"] - r["lo"] >= window).alias("ranges")).where(F.size("ranges") > 0)
    wide = repeated_ranges(keyed, window, inside=inside)
    both = _met(small.withColumnRenamed("ranges", "narrow"), wide, ["ranges"], "left")
    return _met(keyed, both, ["ranges", "narrow"], "left").mapInArrow(_cut, "doc_id bigint, n_bytes bigint, removed array<struct<start:bigint, end:bigint>>, kept binary, repeated array<struct<start:bigint, end:bigint>>")


def query(spark, sf_dir: str) -> DataFrame:
    found = dedup_substrings(C.table(spark, sf_dir, "documents"))
    total = lambda spans: F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", total("removed").alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), total("repeated").alias("n_repeated"))
