"""A kernel quality classifier: random Fourier features, ridge scores, isotonic calibration.

Statistics of each whole text are computed in Arrow batches. Learning uses the labelled rows that are not held out, all
of them: their statistics are standardised, mapped to random Fourier features of a Gaussian kernel, and every partition
sums its share of the normal equations; the sums (a fixed number of rows, whatever the corpus) are added up by row of
the matrix, solved on the driver, and scores are calibrated by isotonic regression over a fixed number of score bins.
The model is a few hundred numbers and travels in the closure of the scoring pass. The statistics themselves stand beside
their Fourier features, which gives the kernel a linear part. The isotonic curve is fitted on the rows that the ridge was
fitted on; held-out rows take part in neither.

Null and empty texts score like empty texts. Rows with null labels or ids are not learnt from, and of several labels of a
document the highest counts. Without a single label
the score is 0.5. Repeated rows get equal scores. An empty table gives no rows. Other columns are ignored or, by `keep_good`, kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestwright.llm import common as C

#: Fourier features, kernel width in standard deviations (per square root of the number of statistics), ridge, score bins.
FEATURES, WIDTH, RIDGE, BINS = 192, 1.0, 1e-3, 512
_CLASSES = np.full(256, 7, np.int64)  # 7: other ASCII
_CLASSES[97:123], _CLASSES[65:91], _CLASSES[48:58], _CLASSES[[0x20, 9, 11, 12, 13]], _CLASSES[10] = 0, 1, 2, 3, 4
_CLASSES[[ord(c) for c in "#*$%&|<>"]], _CLASSES[128:] = 5, 8
_CLASSES[[ord(c) for c in ".,;:!?'\"()-"]] = 6
N_STATS = 22


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of statistics for each document."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    byte = np.maximum(size, 1)[:, None]
    classes = np.bincount(owner * 9 + _CLASSES[data], minlength=n * 9).reshape(n, 9)
    starts, ends, doc = C.words(data, offsets)
    count = np.bincount(doc, minlength=n)
    some = np.maximum(count, 1)
    length = ends - starts
    low = C.LOWER[data]
    hashes = C.span_hashes(low, starts, ends)
    by_doc = lambda x: np.bincount(doc, weights=x, minlength=n) / some

    def distinct(value: np.ndarray, of: np.ndarray) -> np.ndarray:
        order = np.lexsort((value, of))
        v, d = value[order], of[order]
        new = np.append(True, (v[1:] != v[:-1]) | (d[1:] != d[:-1]))[: len(v)]
        return np.bincount(d[new], minlength=n)

    kinds = distinct(hashes, doc)
    at, trigram = C.run_hashes(hashes, doc, 3)
    trigrams = np.bincount(doc[at], minlength=n)
    line_start, line_end = C.runs(data != 10, offsets)
    line_doc = np.searchsorted(offsets, line_start, "right") - 1
    lines = np.bincount(line_doc, minlength=n)
    line_kinds = distinct(C.span_hashes(data, line_start, line_end), line_doc)
    first_upper = (data[starts] >= 65) & (data[starts] < 91) if len(starts) else np.zeros(0, bool)
    end_mark = np.isin(data[ends - 1], [ord(c) for c in ".!?"]) if len(ends) else np.zeros(0, bool)
    symbol = np.isin(data[starts], [ord(c) for c in "#*$%&|<>"]) if len(starts) else np.zeros(0, bool)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    mean = by_doc(length)
    var = np.maximum(by_doc(length.astype(float) ** 2) - mean**2, 0)
    out = np.column_stack([
        classes / byte, np.log1p(count), np.log1p(size), mean, np.sqrt(var), by_doc(length <= 3), by_doc(first_upper), by_doc(end_mark), by_doc(symbol),
        by_doc(same), kinds / some**0.8, 1 - distinct(trigram, doc[at]) / np.maximum(trigrams, 1), 1 - line_kinds / np.maximum(lines, 1), np.log1p(count / np.maximum(lines, 1)),
    ])
    return out.astype(np.float32)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in C.sliced(batches):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(statistics(data, offsets)), pa.list_(pa.float32()))], ["doc_id", "x"])


class Model:
    """Standardisation, random features, ridge weights and a calibration curve."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, deviation
        self.w = rng.normal(size=(len(mean), features)) / (width * np.sqrt(len(mean)))
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.beta: np.ndarray | None = None
        self.curve: tuple[np.ndarray, np.ndarray] | None = None

    def rows(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        return np.column_stack([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), z, np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.rows(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), 0.5) if self.curve is None else np.clip(np.interp(self.raw(x), *self.curve), 0.0, 1.0)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted least-squares fit that never falls (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(value.tolist(), weight.tolist(), strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality") -> Model:
    """Learns from every labelled document that is not held out."""
    with C.scratch():
        return _fitted(docs, labels, target)


def _fitted(docs: DataFrame, labels: DataFrame, target: str) -> Model:
    known = C.void_safe(labels, {"doc_id": "bigint", target: "int"}).where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max(target).alias("y"))
    measured = C.void_safe(docs, {"doc_id": "bigint", "text": "string"}).where(~held_out()).mapInArrow(_measure, "doc_id bigint, x array<float>")
    learnt = C.materialize(measured.join(known, "doc_id").select("x", "y"))
    sums = learnt.select(F.count("*"), *(f(F.get("x", F.lit(i)).cast("double")) for i in range(N_STATS) for f in (F.avg, F.stddev_pop))).first()
    if not sums[0]:
        return Model(np.zeros(N_STATS), np.ones(N_STATS))
    model = Model(np.array(sums[1::2]), np.maximum(np.array(sums[2::2]), 1e-6))

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            rows = model.rows(np.array(batch.column("x").to_pylist(), np.float64))
            y = batch.column("y").to_numpy().astype(float)
            part = np.column_stack([rows.T @ rows, rows.T @ y])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(list(total))], ["i", "v"])

    def added(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [key[0]], "v": [np.sum(np.stack(parts["v"].to_list()), axis=0)]})

    summed = learnt.mapInArrow(normal, "i int, v array<double>").groupBy("i").applyInPandas(added, "i int, v array<double>").collect()  # FEATURES + N_STATS + 1 rows
    m = np.array([r.v for r in sorted(summed, key=lambda r: r.i)])
    n = float(sums[0])
    model.beta = np.linalg.solve(m[:, :-1] / n + RIDGE * np.eye(len(m)), m[:, -1] / n)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw(np.array(batch.column("x").to_pylist(), np.float64))
            bins = np.clip(np.floor((raw + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(raw), batch.column("y")], ["bin", "raw", "y"])

    table = sorted(learnt.mapInArrow(binned, "bin int, raw double, y int").groupBy("bin").agg(F.avg("raw"), F.avg("y"), F.count("*")).collect())  # BINS rows at most
    _, raw, mean, count = (np.array(c, float) for c in zip(*table, strict=True))
    model.curve = raw, isotonic(mean, count)
    return model


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in C.sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(statistics(data, offsets).astype(np.float64)))], ["doc_id", "score"])

    return run


def scores(docs: DataFrame, labels: DataFrame, target: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = fit(docs, labels, target)
    found = C.materialize(C.void_safe(docs, {"doc_id": "bigint", "text": "string"}).mapInArrow(_scored(model), "doc_id bigint, score double"))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, target: str = "quality", least: float = 0.5) -> DataFrame:
    """The rows of docs that score at least `least`, with all their columns."""
    model = fit(docs, labels, target)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in C.sliced(batches):
            yield batch.filter(pa.array(model.score(statistics(data, offsets).astype(np.float64)) >= least))

    return C.materialize(docs.mapInArrow(keep, docs.schema))  # written here, in small Arrow batches


def query(spark, sf_dir: str) -> DataFrame:
    return scores(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
